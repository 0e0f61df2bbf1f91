"""Packing token sequences: non-negative least squares over window fillings, rounded, then greedy for the rest."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, numbered

#: Pieces of one length are numbered in parts of about this many, in at least MIN_PARTS parts.
PART_ROWS, MIN_PARTS = 50_000, 256
#: The rank file's library fails on runs of blanks of some hundred thousand characters; texts with a run of this many go
#: through the other library.
LONG_BLANK = re.compile(r"(?<!\s)\s{5000}")
#: Such a run has 50 blanks in a row at every hundredth place.
SPARSE_BLANK = re.compile(r"\s{50}")


def has_long_blank(text: str) -> bool:
    return len(text) >= 5000 and SPARSE_BLANK.search(text[::100]) is not None and LONG_BLANK.search(text) is not None


#: Steps of the least-squares solver. The histogram has at most a window's number of lengths, so its cost is fixed.
SOLVER_STEPS = 300


@lru_cache(maxsize=2)
def _encoders(path: str):
    """(library tokenizer, the same vocabulary and merges as ranks, its special tokens)."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return whole, *_ranked(path)


@lru_cache(maxsize=2)
def _ranked(path: str):
    """(vocabulary and merges as ranks, special tokens): all that most texts need, without the library tokenizer's memory."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, special


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each document's token ids, then ``end_id``, cut at every ``window`` ids.

    ``ids`` are little-endian unsigned 32-bit integers. A null text counts as empty: one piece with ``end_id``. Texts
    without special tokens or very long runs of blanks go through the rank file beside the tokenizer's, which gives the
    same ids faster. A text of any length is encoded whole.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fast, special = _ranked(tokenizer)
        at, starts, lengths, totals, ids = [], [], [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            text = text or ""
            if any(s in text for s in special) or has_long_blank(text):
                found = _encoders(tokenizer)[0].encode(text, add_special_tokens=False).ids
            else:
                found = fast.encode_ordinary(text)
            found.append(end_id)
            raw = np.array(found, dtype="<u4").tobytes()
            for s in range(0, len(found), window):
                piece = raw[4 * s : 4 * (s + window)]
                at.append(i)
                starts.append(s)
                lengths.append(len(piece) // 4)
                totals.append(len(found))
                ids.append(piece)
        long = pa.int64()
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, long)), pa.array(starts, long), pa.array(lengths, long), pa.array(totals, long), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return arrow_map(docs.select("doc_id", "text"), batch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, ids binary")


def fillings(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of the given lengths that fill the window exactly; 0 stands for no third piece."""
    there = np.zeros(window + 1, bool)
    there[lengths[lengths < window]] = True
    out = []
    for a in np.flatnonzero(there):
        b = np.arange(a, window + 1)
        c = window - a - b
        ok = there[b] & (c >= 0) & ((c == 0) | ((c >= b) & there[np.maximum(c, 0)]))
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def solve_counts(combos: np.ndarray, hist: np.ndarray, steps: int = SOLVER_STEPS) -> np.ndarray:
    """Non-negative x with the least ``|A x - hist|``, where column j of A counts the lengths in ``combos[j]``.

    Multiplicative updates keep x non-negative and never raise the error.
    """
    if not len(combos):
        return np.zeros(0)
    rows = combos.T
    weight = (rows > 0).astype(float)
    up = lambda y: sum(y[r] * w for r, w in zip(rows, weight, strict=True))  # noqa: E731  A' y
    down = lambda x: sum(np.bincount(r, x * w, len(hist)) for r, w in zip(rows, weight, strict=True))  # noqa: E731  A x
    target = up(hist)
    x = np.full(len(combos), hist.sum() / (3 * len(combos)))
    for _ in range(steps):
        x *= target / np.maximum(up(down(x)), 1e-12)
    return x


def plan(hist: dict[int, int], window: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, sequence, offset): the pieces of that length ranked low to high - 1 go to sequences from
    ``sequence`` on, one each, at ``offset``.

    Full pieces are sequences of their own. Fillings get their rounded counts from the least-squares solution, as far as
    pieces are left; what is left then is packed greedily, the longest piece first and the longest that still fits next.
    """
    left = np.zeros(window + 1, np.int64)
    for length, n in hist.items():
        if not 1 <= length <= window:
            raise ValueError("a piece is longer than the window or empty")
        left[length] = n
    used = np.zeros(window + 1, np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def put(pattern: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length in pattern:
            out.append((int(length), int(used[length]), int(used[length] + times), sequence, offset))
            used[length] += times
            left[length] -= times
            offset += int(length)
        sequence += int(times)

    def most(pattern: list[int]) -> int:
        return min(int(left[p]) // pattern.count(p) for p in pattern)

    if left[window]:
        put([window], int(left[window]))
    combos = fillings(np.flatnonzero(left), window)
    counts = np.floor(solve_counts(combos, left.astype(float)) + 0.5).astype(np.int64)
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] < 1:
            break
        pattern = [int(p) for p in combos[j] if p]
        if (times := min(int(counts[j]), most(pattern))) > 0:
            put(pattern, times)
    while left.any():
        pattern, room, free = [], window, left.copy()
        while (fits := np.flatnonzero(free[: room + 1])).size:
            pattern.append(int(fits[-1]))
            free[fits[-1]] -= 1
            room -= int(fits[-1])
        put(pattern, most(pattern))
    return out


def pack(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to ``window`` tokens; every piece is placed whole.

    Only the histogram of lengths (at most ``window`` numbers) comes to the driver, and only the plan, whose rows are
    bounded by the window alone, is broadcast. Pieces of one length are ranked in parts, so a length that a third of
    all pieces have is no single task. Pieces that are equal in all of doc_id, start and length are interchangeable.
    ``pieces`` is evaluated several times: cut its lineage before.
    """
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = np.array(plan(hist, window), np.int64).reshape(-1, 5)
    # From Arrow: rows of Python would go through Python workers of a pool of their own, which stay in the executors' memory.
    table = spark.createDataFrame(pa.table(dict(zip(["length", "_low", "_high", "_sequence", "offset"], slots.T, strict=True))))
    parts = max(MIN_PARTS, -(-max(hist.values(), default=0) // PART_ROWS))
    ranked = numbered(pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts))), ["length"], "_part", ["doc_id", "start"], "_place").drop("_part")
    placed = ranked.join(F.broadcast(table), "length").filter((F.col("_place") >= F.col("_low")) & (F.col("_place") < F.col("_high")))
    return placed.withColumn("sequence_id", F.col("_sequence") + F.col("_place") - F.col("_low")).drop("_low", "_high", "_sequence", "_place")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024) -> DataFrame:
    """Per piece of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Rows that share a doc_id, or have none, are packed each for itself. An empty table gives no rows. Other columns are
    not read. The ids of a piece are those of ``token_pieces`` at (doc_id, start).
    """
    pieces = token_pieces(docs, tokenizer, window)
    slim = materialize(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return pack(slim, window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
