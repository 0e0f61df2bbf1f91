"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens until buckets are small.

Tokens are hashes of five words in a row. A path chooses each token of a set with chance ``1 / (share * size)``,
by a hash of path and token, so similar sets choose the same; after some levels, and more where a bucket is
still large, the sets in a bucket are compared. Independent runs repeat this until the recall aimed at, and sets of
large buckets, whose pairs are lost more often, take more runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, slices
from .graph import PARTS, components

WORDS = 5
WORD = re.compile(r"\w+")
#: Levels taken at once, and levels after which a large bucket is cut into blocks and not split further.
FIRST_LEVELS, MAX_LEVELS = 3, 7
#: Sets in a bucket, or in a block of a larger one, that are compared with each other in one go, and their tokens.
BLOCK, BLOCK_TOKENS = 500, 4_000_000
#: Tokens of a set that are tried at once.
SLICE = 1 << 16
BINS = 128
#: Estimates may fall short of the similarity by this much: about four standard errors.
MARGIN = 0.15
CACHED_WORDS = 50_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_words: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def tokens_of(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer than five words has one shingle, of none, none."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) >= CACHED_WORDS:
        _words.clear()
    found = list(map(_words.get, words))
    for i, h in enumerate(found):
        if h is None:
            found[i] = _words[words[i]] = xxhash.xxh64_intdigest(words[i].encode())
    w = np.array(found, np.uint64)
    n = max(1, len(w) - WORDS + 1)
    total = np.full(n, min(len(w), WORDS), np.uint64)
    for j in range(min(WORDS, len(w))):
        total += w[j : j + n] * _ODD[j]
    return np.unique(mix(total))


def key_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def descend(tokens: np.ndarray, paths: np.ndarray, levels: int, share: float) -> np.ndarray:
    """The paths of a set that are ``levels`` longer than the given ones."""
    limit = np.uint64(min(2**64 - 1, int(2**64 / (share * len(tokens)))))
    for _ in range(levels):
        found = []
        for start in range(0, len(tokens), SLICE):
            part = tokens[start : start + SLICE]
            at, chosen = np.nonzero(mix(part[None, :] ^ paths[:, None]) <= limit)
            found.append(mix(paths[at] + part[chosen] * _ODD[0]))
        paths = np.unique(np.concatenate(found))
    return paths


def sketch_of(tokens: np.ndarray) -> bytes:
    """A byte of the least token in each of BINS ranges, 0 where there is none."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
    first = np.searchsorted(tokens, edges)
    there = first < len(tokens)
    value = tokens[np.minimum(first, len(tokens) - 1)]
    there &= value >> np.uint64(57) == np.arange(BINS, dtype=np.uint64)
    return np.where(there, np.maximum(value & np.uint64(255), np.uint64(1)), 0).astype(np.uint8).tobytes()


def missed(levels: int) -> float:
    """The chance that a run misses a pair of the least similarity: a path shared by a pair has one shared child on
    average, so over ``levels`` levels the shared paths die out as a branching process of mean 1."""
    out = 0.0
    for _ in range(levels):
        out = exp(out - 1)
    return out


def runs_for(recall: float) -> tuple[int, int]:
    """Runs of all sets, and further runs of the sets that have a bucket of over BLOCK.

    Pairs that share no path after FIRST_LEVELS in the first runs are lost. Those that do, but only in large buckets, may
    be lost on the way to MAX_LEVELS; both their sets then take the further runs. The first runs are one more than
    they alone need, which leaves room for the second loss: both together stay within ``1 - recall``.
    """
    runs = ceil(log(1 - recall) / log(missed(FIRST_LEVELS))) + 1
    apart, lost = missed(FIRST_LEVELS) ** runs, missed(MAX_LEVELS) ** runs
    return runs, ceil(log((1 - recall - apart) / (lost - apart)) / log(missed(MAX_LEVELS)))


def seeds_of(first: int, last: int) -> np.ndarray:
    """The empty paths that the runs begin with."""
    return mix(np.arange(first + 1, last + 1, dtype=np.uint64) * _ODD[1])


def sets_of(docs: DataFrame, runs: int, similarity: float) -> DataFrame:
    """(doc_id, mark, key, size, sketch, paths) of each row; ``mark`` is a hash of the text, the rest null without a word."""
    seeds = seeds_of(0, runs)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, sketches, paths = [], [], [], []
        for text in b.column(2).to_pylist():
            t = tokens_of(text)
            keys.append(key_of(t) if len(t) else None)
            sizes.append(len(t) or None)
            sketches.append(sketch_of(t) if len(t) else None)
            paths.append(descend(t, seeds, FIRST_LEVELS, similarity).view(np.int64) if len(t) else None)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], ["doc_id", "mark", "key", "size", "sketch", "paths"])

    return arrow_map(docs.select("doc_id", mark_of(), "text"), batch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, key binary, size int, sketch binary, paths array<long>")


def mark_of() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text").alias("mark")


def rows_of(batches: Iterator[pa.RecordBatch], arrow: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    """The rows, as dictionaries, that ``make`` gives for each row."""
    for b in batches:
        out: list[dict] = []
        for i in range(b.num_rows):
            out += make(*(c[i].as_py() for c in b.columns))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, arrow)


def tokens_for(docs: DataFrame, wanted: DataFrame, begun: np.ndarray, similarity: float) -> DataFrame:
    """(key, tokens, children) of the sets that are wanted (key, doc_id, mark, paths): texts move once, for all that follows.

    ``children`` are the paths of a set of large buckets that are one level longer than ``paths``, and those of its further
    runs at the same level. The join is always by sorting, whatever the size of ``wanted``.
    """
    w = wanted.withColumnRenamed("doc_id", "_id").withColumnRenamed("mark", "_mark").hint("merge")
    texts = docs.select("doc_id", mark_of(), "text")
    joined = texts.join(w, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "key", "paths")
    arrow = pa.schema([("key", pa.binary()), ("tokens", pa.binary()), ("children", pa.list_(pa.int64()))])

    def make(text: str, key: bytes, paths: list[int] | None) -> list[dict]:
        t = tokens_of(text)
        children = None
        if paths:
            start = np.array(paths, np.int64).view(np.uint64)
            children = np.concatenate([descend(t, start, 1, similarity), descend(t, begun, FIRST_LEVELS + 1, similarity)]).view(np.int64).tolist()
        return [{"key": key, "tokens": t.tobytes(), "children": children}]

    return joined.mapInArrow(lambda batches: rows_of(batches, arrow, make), "key binary, tokens binary, children array<long>")


def children_of(tokens: DataFrame, large: DataFrame, similarity: float) -> DataFrame:
    """(key, path): the paths of sets of large buckets (key, path) that are one level longer."""
    paths = large.groupBy("key").agg(F.collect_list("path").alias("paths"))
    arrow = pa.schema([("key", pa.binary()), ("path", pa.int64())])

    def make(key: bytes, raw: bytes, paths: list[int]) -> list[dict]:
        longer = descend(np.frombuffer(raw, np.uint64), np.array(paths, np.int64).view(np.uint64), 1, similarity)
        return [{"key": key, "path": p} for p in longer.view(np.int64).tolist()]

    return tokens.join(paths, "key").select("key", "tokens", "paths").mapInArrow(lambda batches: rows_of(batches, arrow, make), "key binary, path long")


def cells(rows: DataFrame, group: str, least: float, weighed: bool = False) -> DataFrame:
    """Deal the sets of each group (``group``, key, size, and n, the group's number of sets) into cells to compare.

    A group of at most BLOCK sets is a cell. A larger one is cut into bands of sizes, so that sets of which the smaller has
    a share of ``least`` of the larger's size lie in the same band or in neighbours, and bands into blocks; each two blocks
    that may hold such sets are a cell, and a set appears in the cells of its block. ``weighed``: rows also have w, the
    tokens of the group, and blocks hold about BLOCK_TOKENS of them at most. Adds _cell, _block, and _mixed where only pairs
    of two blocks are new.
    """
    parts = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_TOKENS) if weighed else n / BLOCK).cast("int")
    w = F.col("w") if weighed else F.lit(0)
    rows = rows.withColumn("_parts", parts(F.col("n"), w))
    whole = rows.filter("_parts = 1").select(group, "key", F.xxhash64(group).alias("_cell"), F.lit(0).cast("long").alias("_block"), F.lit(False).alias("_mixed"))
    cut = rows.filter("_parts > 1").withColumn("_band", F.floor(F.log("size") / -log(least)).cast("int"))
    bands = cut.groupBy(group, "_band").agg(parts(F.count(F.lit(1)), F.sum("size")).alias("_own"))
    order = W.partitionBy(group).orderBy("_band")
    beside = lambda f, step: F.when(f("_band").over(order) == F.col("_band") + step, f("_own").over(order)).otherwise(0)
    bands = bands.select(group, "_band", "_own", beside(F.lead, 1).alias("_next"), beside(F.lag, -1).alias("_last"))
    dealt = cut.join(bands, [group, "_band"]).withColumn("_i", F.pmod(F.xxhash64("key"), F.col("_own")).cast("int"))
    i, band = F.col("_i"), F.col("_band")
    upto = lambda name: F.when(F.col(name) > 0, F.sequence(F.lit(0), F.col(name) - 1)).otherwise(F.expr("cast(array() AS array<int>)"))
    cell = lambda low, x, high, y, mixed: F.struct(F.xxhash64(group, low, x, high, y).alias("_cell"), mixed.alias("_mixed"))
    mine = F.transform(upto("_own"), lambda j: cell(band, F.least(i, j), band, F.greatest(i, j), i != j))
    up = F.transform(upto("_next"), lambda j: cell(band, i, band + 1, j, F.lit(True)))
    down = F.transform(upto("_last"), lambda j: cell(band - 1, j, band, i, F.lit(True)))
    dealt = dealt.withColumn("_at", F.explode(F.concat(mine, up, down)))
    block = F.shiftleft(band.cast("long"), 32) + i
    return whole.union(dealt.select(group, "key", F.col("_at._cell"), block.alias("_block"), F.col("_at._mixed")))


def by_cell(df: DataFrame, names: list[str], schema: str, handle) -> DataFrame:
    """``handle(rows)`` for the rows of each cell, a list of tuples of ``names`` in no order; it gives rows of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    dealt = df.select("_cell", *names).repartition("_cell").sortWithinPartitions("_cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, out = None, []

        def flush():
            nonlocal out
            cols = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in slices(batches):
            for cell, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cell != last:
                    if len(held) > 1:
                        out += handle(held)
                    held, last = [], cell
                held.append(tuple(row))
            if len(out) > 20_000:
                yield flush()
        if len(held) > 1:
            out += handle(held)
        yield flush()

    return dealt.mapInArrow(run, schema)


def union(root: list[int], i: int, j: int) -> None:
    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    i, j = find(i), find(j)
    root[max(i, j)] = min(i, j)


def likely(rows: list[tuple], least: float) -> list[tuple[bytes, bytes]]:
    """Links enough to join all sets of a bucket whose sketches look similar: at most one fewer than sets."""
    rows = list({r[0]: r for r in rows}.values())
    m = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), BINS)
    size = np.array([r[2] for r in rows])
    block, mixed = np.array([r[3] for r in rows]), rows[0][4]  # of two blocks, only pairs across are new
    root = list(range(len(rows)))
    for i in range(len(rows) - 1):
        o = m[i + 1 :]
        same = ((o == m[i]) & (o > 0)).sum(axis=1)
        either = np.maximum(((o > 0) | (m[i] > 0)).sum(axis=1), 1)
        small, large = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
        ok = (same >= least * either) & (small >= least * large)
        if mixed:
            ok &= block[i + 1 :] != block[i]
        for j in np.flatnonzero(ok):
            union(root, i, i + 1 + int(j))
    return [(rows[i][0], rows[root[i]][0]) for i in range(len(rows)) if root[i] != i]


def verified(rows: list[tuple], similarity: float) -> list[tuple[bytes, bytes, int]]:
    """(key, least set it is joined to, documents it is linked to) for the sets of a cell, by exact similarity."""
    rows = list({r[0]: r for r in rows}.values())
    sets = [np.frombuffer(r[1], np.uint64) for r in rows]
    flat, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    copies = np.array([r[2] for r in rows])
    block, mixed = np.array([r[3] for r in rows]), rows[0][4]  # of two blocks, only pairs across are new
    root, links = list(range(len(rows))), np.zeros(len(rows), np.int64)
    there = np.zeros(len(flat), bool)
    for i in range(len(rows)):
        own = numbers[starts[i] : starts[i] + size[i]]
        there[own] = True
        shared = np.add.reduceat(there[numbers], starts, dtype=np.int64)
        there[own] = False
        ok = shared >= similarity * (size + size[i] - shared) - 1e-9
        ok[i] = False
        if mixed:
            ok &= block != block[i]
        links[i] = copies[ok].sum()
        for j in np.flatnonzero(ok[:i]):
            union(root, i, int(j))
    return [(rows[i][0], rows[root[i]][0], int(links[i])) for i in range(len(rows)) if links[i] or root[i] != i]


def decided(docs: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Per row: doc_id, mark, class_id, n_links, and whether it is the first row of its class. See ``join_similar``."""
    runs, further = runs_for(recall)
    work = Workspace(docs.sparkSession)
    found = work.keep(sets_of(docs, runs, similarity), "sets")
    # What a set's copies have in common is read from any of them; its first row has the least doc_id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    reps = found.filter(F.col("key").isNotNull()).groupBy("key").agg(first, F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("size", "sketch", "paths")])
    reps = work.keep(reps, "classes")

    def shared(nodes: DataFrame) -> DataFrame:
        # With a second key both sides are dealt for the join itself, so that Spark may split a path that very many sets have.
        part = F.pmod(F.xxhash64("path"), F.lit(PARTS)).alias("part")
        counts = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("*", part)
        return work.keep(nodes.select("*", part).join(counts, ["path", "part"]).drop("part"), "buckets")

    def likely_links(buckets: DataFrame) -> DataFrame:
        least = similarity - MARGIN
        dealt = cells(buckets.join(reps.select("key", "size"), "key"), "path", least).join(reps.select("key", "sketch", "size"), "key")
        return work.keep(by_cell(dealt, ["key", "sketch", "size", "_block", "_mixed"], "a binary, b binary", lambda rows: likely(rows, least)), "likely")

    buckets = shared(reps.select("key", F.explode("paths").alias("path")))
    links = likely_links(buckets.filter(F.col("n") <= BLOCK))
    large = buckets.filter(F.col("n") > BLOCK).groupBy("key").agg(F.collect_list("path").alias("paths"))
    linked = links.select(F.col("a").alias("key")).union(links.select("b")).distinct().withColumn("paths", F.expr("cast(NULL AS array<long>)"))
    wanted = large.union(linked).groupBy("key").agg(F.max("paths").alias("paths"))
    wanted = wanted.join(reps.select("key", "first"), "key").select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"), "paths")
    # Sets of large buckets enter the further runs here, at the level that is next for their paths.
    tokens = work.keep(tokens_for(docs, wanted, seeds_of(runs, runs + further), similarity), "tokens")
    nodes = tokens.select("key", F.explode("children").alias("path"))
    for level in range(FIRST_LEVELS + 1, MAX_LEVELS + 1):
        last, buckets = buckets, shared(nodes)
        work.drop(last)
        done = buckets if level == MAX_LEVELS else buckets.filter(F.col("n") <= BLOCK)
        links = links.union(likely_links(done))
        large = buckets.filter(F.col("n") > BLOCK)
        if level == MAX_LEVELS or large.isEmpty():
            break
        nodes = children_of(tokens, large, similarity)
    groups = components(links, work).withColumnRenamed("node", "key").join(reps.select("key", "size", "copies"), "key")
    groups = work.keep(groups, "groups")
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    dealt = cells(groups.join(sizes, "label"), "label", similarity, weighed=True)
    dealt = dealt.join(tokens.select("key", "tokens"), "key").join(groups.select("key", "copies"), "key")
    exact = by_cell(dealt, ["key", "tokens", "copies", "_block", "_mixed"], "key binary, root binary, links long", lambda rows: verified(rows, similarity))
    exact = work.keep(exact, "links")
    work.drop(tokens, buckets)
    joined = components(exact.select(F.col("key").alias("a"), F.col("root").alias("b")), work)
    counted = exact.groupBy("key").agg(F.sum("links").alias("links"))
    # Only sets with copies or links; all others are classes of their own.
    per_set = reps.select("key", "first", "copies").join(counted, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left").filter("copies > 1 OR links > 0")
    per_set = work.keep(per_set.select("key", "first", F.coalesce("label", "key").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "per_set")
    head = per_set.groupBy("label").agg(F.min("first").alias("head"))
    per_set = work.keep(per_set.join(head, "label").select("key", "head", "n_links"), "heads")
    out = found.select("doc_id", "mark", "key").join(per_set, "key", "left")
    alone = F.col("head").isNull()
    return out.select(
        "doc_id",
        "mark",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark")))).alias("is_first"),
    )


def join_similar(docs: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """Per row: doc_id, class_id and n_links.

    n_links counts the other rows whose sets of five-word shingles (lower-case words, runs of ``WORD``) have a Jaccard similarity
    of ``similarity`` or more; class_id is the least doc_id that can be reached by such links. Equal sets are handled
    once, with their number of copies, so copies are never expanded into pairs. A text of fewer than five words is one
    shingle. A null text or one without words has no links and is a class of its own: class_id is its doc_id. Rows that
    share a doc_id count each for itself. A null doc_id takes part and gets its class; it is the class_id only where no
    row of the class has a doc_id. Texts of any length are taken whole, in slices of their tokens. Every link between sets
    that some run brings into one bucket, directly or over other similar sets, is found and verified exactly; ``recall`` is
    the least chance of that for a single pair, whether its buckets are large or not.
    """
    return decided(docs, similarity, recall).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, columns: list[str], similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """``columns`` of the rows that stay: of each class, the first by doc_id (then by a hash of the text).

    Rows are told apart by doc_id and text, so a row whose doc_id another row has too goes only if its own text is a copy.
    Rows alike in both are one. A row without a doc_id stays only where no row of its class has one.
    """
    gone = decided(docs, similarity, recall).filter(~F.col("is_first")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    rows = docs.select(F.struct(*columns).alias("_kept"), "doc_id", mark_of())
    stay = rows.join(gone, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    return stay.select("_kept.*")
