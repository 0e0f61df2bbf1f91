"""Alignment of two tokenizers: each byte of a text has a label (no end, end of an A token, of a B token, of both), a regular
expression scans the labels for spans up to each byte where both end, and the labels in a span count its tokens.

Two tokens are linked where their bytes overlap; how often the ids of a link are linked in the whole corpus says how
well they correspond. Documents are worked on in chunks: a chunk knows its distinct pairs of ids, so the corpus' counts
are asked for once a chunk and not once a document.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace
from .packing import has_long_blank

#: Labels of a byte: the sum of those that hold. 3 is the end of both.
A_END, B_END = 1, 2
#: A span: labels up to and with the first that ends both. Bytes at which no token ends are left out before, and spans of
#: one label, which most are, are found by the run.
SPAN = re.compile(rb"\x03+|[\x01\x02]+\x03")
FIRST = itemgetter(0)
#: Links, or documents, after which a chunk of documents is closed. A document is never divided.
CHUNK_LINKS, CHUNK_DOCS = 1_000_000, 20_000
#: A pair of ids as one number: a * PAIR + b.
PAIR = 1 << 32
CHUNK = "docs array<struct<doc: {kept}, n_a: long, n_b: long, n_groups: long, n_links: long, groups: string, pairs: array<int>, times: array<int>>>, pairs array<long>, links array<long>"


@lru_cache(maxsize=2)
def _tokenizers(a_path: str, b_path: str):
    """(A, the same vocabulary by its rank file if there is one, bytes of A's tokens, B, bytes of B's tokens)."""
    import public_tokenizers
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    fast, ranked = None, a_path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranked):
        with open(ranked, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    a = Tokenizer.from_file(a_path)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    a_bytes: list[bytes] = [b""] * a.get_vocab_size(with_added_tokens=True)
    letters = byte_letters()
    for token, i in a.get_vocab(with_added_tokens=True).items():
        a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", piece) else piece.replace("▁", " ").encode())
    return a, fast, a_bytes, b, b_bytes


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(own)]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(rest)}


def labels_of(a_sizes: np.ndarray, b_sizes: np.ndarray) -> bytes:
    """The labels of a text's bytes, from the sizes of its tokens, without those at which no token ends."""
    a_stop = np.cumsum(a_sizes)
    out = np.zeros(int(a_stop[-1]), np.uint8)
    out[a_stop - 1] = A_END
    out[np.cumsum(b_sizes) - 1] += B_END
    return out.tobytes().translate(None, b"\0")


def token_groups(labels: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the A and of the B tokens of each group, by the spans that end where both tokens end; places of the A and
    of the B token of each link: between two neighbouring ends just one pair of tokens overlaps."""
    found = SPAN.findall(labels)
    size, run = np.fromiter(map(len, found), np.int64), np.fromiter(map(FIRST, found), np.uint8) == A_END + B_END
    last = np.cumsum(np.repeat(np.where(run, 1, size), np.where(run, size, 1))) - 1
    values = np.frombuffer(labels, np.uint8)
    a_bit, b_bit = values & A_END, values >> 1
    a_upto, b_upto = np.cumsum(a_bit, dtype=np.int64), np.cumsum(b_bit, dtype=np.int64)
    return np.diff(a_upto[last], prepend=0), np.diff(b_upto[last], prepend=0), a_upto - a_bit, b_upto - b_bit


def told(a_ids: np.ndarray, b_ids: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray) -> bytes:
    """Groups as text: ids of A, a bar, ids of B; groups parted by semicolons."""
    a_last, b_last = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    a_stop, b_stop = np.cumsum(a_counts), np.cumsum(b_counts)
    a_last[a_stop - 1], b_last[b_stop - 1] = True, True
    # Tokens in the order of groups, those of A first: a token goes behind those of the other side in the groups before,
    # one of B also behind A's of its own group. A token's number names its text and the mark after it.
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    codes[np.arange(len(a_ids)) + np.repeat(b_stop - b_counts, a_counts)] = 2 * a_ids + a_last
    codes[np.arange(len(b_ids)) + np.repeat(a_stop, b_counts)] = 2 * b_ids + b_last + 2 * _A_SIDE
    return _texts()[codes].tobytes().translate(None, b"\0")[:-1]


#: Ids below this have their texts in one table for each side.
_A_SIDE = 1 << 17


@lru_cache(maxsize=1)
def _texts() -> np.ndarray:
    """Texts as numbers of eight bytes, filled up with zeros."""
    sides = (",", "|"), (",", ";")
    return np.array([f"{i}{mark}" for marks in sides for i in range(_A_SIDE) for mark in marks], "S8").view(np.uint64)


def align(text: str | None, a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray, bytes] | None:
    """(ids of A, ids of B, labels) of a space and the text; None for a text without tokens: null, empty, or not
    given back byte for byte by both tokenizers."""
    if not text:
        return None
    a, fast, a_bytes, b, b_bytes = _tokenizers(a_path, b_path)
    whole = (" " + text).encode()
    a_sizes, b_sizes = _sizes(a_path, b_path)
    b_array = b.encode_as_numpy(text)
    if b"".join(map(b_bytes.__getitem__, b_array.tolist())) != whole:
        return None
    if fast is None or has_long_blank(text):
        a_ids = a.encode(" " + text, add_special_tokens=False).ids
        given = b"".join(map(a_bytes.__getitem__, a_ids))
    else:
        a_ids = fast.encode_ordinary(" " + text)
        given = fast.decode_bytes(a_ids)
    if given != whole:
        return None
    a_array = np.array(a_ids, np.int64)
    return a_array, b_array.astype(np.int64), labels_of(a_sizes[a_array], b_sizes[b_array])


@lru_cache(maxsize=2)
def _sizes(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token of A and of B."""
    _, _, a_bytes, _, b_bytes = _tokenizers(a_path, b_path)
    return np.array([*map(len, a_bytes)]), np.array([*map(len, b_bytes)])


class Chunk:
    """Documents of one task until they have CHUNK_LINKS links, and the distinct pairs of ids in them."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.links = 0

    def add(self, text: str | None, a_path: str, b_path: str) -> None:
        found = align(text, a_path, b_path)
        if found is None:
            self.rows.append((0, 0, 0, 0, b""))
            self.keys.append(np.zeros(0, np.int64))
            self.times.append(np.zeros(0, np.int64))
            return
        a_ids, b_ids, labels = found
        a_counts, b_counts, i, j = token_groups(labels)
        keys, times = np.unique(a_ids[i] * PAIR + b_ids[j], return_counts=True)
        self.rows.append((len(a_ids), len(b_ids), len(a_counts), len(i), told(a_ids, b_ids, a_counts, b_counts)))
        self.keys.append(keys)
        self.times.append(times)
        self.links += len(i)

    def table(self, kept: pa.Array, groups) -> pa.RecordBatch:
        """One row: the documents, each with its pairs as places in the chunk's, and the chunk's pairs with their links."""
        sizes = [len(k) for k in self.keys]
        distinct, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        times = np.concatenate(self.times)
        links = np.bincount(place, times, len(distinct)).astype(np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (place, times)]
        numbers = [pa.array([r[c] for r in self.rows], pa.int64()) for c in range(4)]
        names = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
        docs = pa.StructArray.from_arrays([kept, *numbers, pa.array([groups(r[4]) for r in self.rows]), *lists], names)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([one(docs), one(pa.array(distinct)), one(pa.array(links))], ["docs", "pairs", "links"])


def digest(groups: bytes) -> str:
    return hashlib.sha256(groups).hexdigest() if groups else ""


def chunked(docs: DataFrame, a_path: str, b_path: str, keep: list[str], digests: bool) -> DataFrame:
    """(chunk, docs, pairs, links): the documents of a task, aligned, in chunks."""
    inner = docs.select(F.struct(*keep).alias("kept"), "text")
    schema = CHUNK.format(kept=inner.schema["kept"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, kept = Chunk(), []
        close = lambda: chunk.table(pa.concat_arrays(kept), digest if digests else bytes.decode)
        for b in batches:
            first = 0
            for i, text in enumerate(b.column(1)):
                chunk.add(text.as_py(), a_path, b_path)
                if chunk.links >= CHUNK_LINKS or len(chunk.rows) >= CHUNK_DOCS:
                    kept.append(b.column(0).slice(first, i + 1 - first))
                    first = i + 1
                    yield close()
                    chunk, kept = Chunk(), []
            kept.append(b.column(0).slice(first))
        if chunk.rows:
            yield close()

    return inner.mapInArrow(run, schema).withColumn("chunk", F.monotonically_increasing_id())


def align_documents(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """``keep`` (default: doc_id), n_a, n_b, n_groups, n_links, ``groups`` (the text of the groups, or with ``digests`` its
    hash), n_best and count_sum of every document.

    A is a byte-level vocabulary of the tokenizers library (texts go through the rank file beside it, which gives the same ids
    faster, but for very long runs of blanks) and gets a space before the text; B is a model of pieces that
    adds the space itself. Special tokens are plain text. A text that is null, empty, or not given back byte for byte by
    both has no tokens: zeros and an empty text. Each row is a document of its own, whatever its id; other columns may have
    any names. ``count_sum`` adds up, over a document's links, how many links of all documents have the same two ids;
    ``n_best`` counts its links whose ids are linked as often as any A id is with that B id.
    """
    kept = keep or ["doc_id"]
    work = Workspace(docs.sparkSession)
    chunks = work.keep(chunked(docs, a_path, b_path, kept, digests), "chunks")
    asked = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    counts = work.keep(asked.groupBy("pair").agg(F.sum("links").alias("count")), "counts")
    highest = F.max("count").over(W.partitionBy(F.col("pair") % PAIR))
    counts = counts.withColumn("best", F.col("count") == highest)
    answer = asked.select("chunk", "pair").join(counts, "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("known"))
    answer = answer.select("chunk", F.col("known.count").alias("count"), F.col("known.best").alias("best"))
    rows = chunks.select("chunk", "docs").join(answer, "chunk", "left").select("docs", "count", "best")
    kept_type = docs.select(F.struct(*kept).alias("k")).schema["k"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = b.column(0).slice(k, 1).flatten()
                count, best = (b.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
                pairs, times = own.field("pairs"), own.field("times").flatten().to_numpy()
                place, of = pairs.flatten().to_numpy(), np.repeat(np.arange(len(own)), pairs.value_lengths().to_numpy())
                add = lambda values: _sums(of, values, len(own))
                n_best = add(times.astype(np.int64) * best[place].astype(np.int64)) if len(place) else np.zeros(len(own), np.int64)
                total = add(times.astype(np.int64) * count[place]) if len(place) else n_best
                yield pa.RecordBatch.from_arrays([*(own.field(c) for c in ("doc", "n_a", "n_b", "n_groups", "n_links", "groups")), pa.array(n_best), pa.array(total)], ["doc", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])

    out = rows.mapInArrow(finish, f"doc {kept_type}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    return out.select(*[F.col("doc")[k].alias(k) for k in kept], "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of the values of each document."""
    out = np.zeros(n, np.int64)
    np.add.at(out, of, values)
    return out
