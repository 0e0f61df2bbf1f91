"""Approximate nearest neighbours over shifted space-filling curves.

Each curve is a Hilbert order of the vectors projected onto a few random directions and shifted at random. Spark
range-partitions each order; windows of neighbouring keys around every query are searched, merged and reranked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, arrow_map
from .ngramjoin import by_cell

#: Curves, projections of each (as many as fit into a key), and the most bits of one.
CURVES, DIMS, BITS, KEY_BITS = 20, 20, 9, 62
#: Rows of the sample that the window is fitted on, its queries, and the fewest neighbours looked for there.
SAMPLE, SAMPLE_QUERIES, SAMPLE_NEAREST = 4000, 200, 5
#: Most rows of a block, and about the most queries that meet it in one cell, however many there are of either.
BLOCK, BLOCK_QUERIES = 20_000, 20_000
#: Queries of a cell that are multiplied at once, if they lie within a quarter of half a window.
AT_ONCE = 64


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative integers below ``2**bits`` (Skilling's transform)."""
    x = cells.astype(np.uint64).T.copy()
    one, zero = np.uint64(1), np.uint64(0)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        p = q - one
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, zero, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        turn ^= np.where((x[-1] & q) != 0, q - one, zero)
    x ^= turn
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key.astype(np.int64)


@dataclass
class Curves:
    """Directions and shifts of the curves, the largest norm, and the spread of projections."""

    directions: np.ndarray
    shifts: np.ndarray
    norm: float
    spread: float

    def keys(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(curve, row) keys. A further component makes all rows equally long and leaves inner products with
        queries, which have 0 there, as they are: the largest inner product is the least distance."""
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        more = np.zeros_like(length) if query else np.sqrt(np.maximum(self.norm**2 - length**2, 0))
        points = np.hstack([vectors * (self.norm / length) if query else vectors, more])
        out, bits = [], min(BITS, KEY_BITS // self.directions.shape[2])
        for a, shift in zip(self.directions, self.shifts, strict=True):
            unit = np.clip((points @ a / self.spread + 4) / 8, 0, 1)
            out.append(hilbert(np.minimum((unit + shift) / 1.5 * (1 << bits), (1 << bits) - 1).astype(np.int64), bits))
        return np.array(out)


def fit_curves(sample: np.ndarray, norm: float, recall: float, share: float, curves: int = CURVES, seed: int = 5) -> tuple[Curves, float]:
    """Random curves, and the least window, as a share of all rows, that reaches the recall on the sample against brute force.

    Looked for is the ``share`` of the sample's rows that is nearest, SAMPLE_NEAREST at least: at that rank the sample's
    neighbours lie as far out as those of the query among all rows, or farther.
    """
    rnd = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    dims = min(DIMS, d)
    directions = np.array([np.linalg.qr(rnd.normal(size=(d, dims)))[0] for _ in range(curves)])
    out = Curves(directions, rnd.uniform(0, 0.5, size=(curves, dims)), norm, 1.0)
    out.spread = float(np.std(np.hstack([sample, np.zeros((len(sample), 1))]) @ np.concatenate(directions, axis=1))) or 1.0
    n = len(sample)
    queries = np.arange(min(n, SAMPLE_QUERIES))
    products = sample[queries] @ sample.T
    products[queries, queries] = -np.inf
    near = np.argsort(-products, axis=1)[:, : min(max(SAMPLE_NEAREST, int(np.ceil(share * n))), n - 1)]
    if not near.size:
        return out, 2.0
    rows, asked = out.keys(sample, False), out.keys(sample[queries], True)
    best = np.full(near.shape, n)
    for k, q in zip(rows, asked, strict=True):
        order = np.argsort(k, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        best = np.minimum(best, np.abs(place[near] - np.searchsorted(k[order], q)[:, None]))
    return out, float(2 * (np.quantile(best, recall, method="higher") + 1) / n)


def search(vectors: DataFrame, k: int = 20, query_every: int = 20, recall: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found, for rows whose id is divisible by ``query_every``.

    A vector that is null, zero, of another length than most, or holds a null or a number that is not finite takes no part;
    nor does a row without an id. Rows that share an id are one row: a query never finds its own id, and no id is found
    twice. Equal vectors are indexed once, with the ``k + 1`` smallest ids, which are all that can be asked for; so a
    vector that a third of all rows have is no hot spot. All other rows are indexed. Windows are fitted on SAMPLE
    vectors and are shares of all rows, so that recall does not fall as rows are added; for vectors without structure they
    are wide, and the work of a query is a share of all rows. Ties go to the smaller id, however many there are. With fewer
    candidates, all are returned.
    """
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    e = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(whole, F.lit(False)))
    rows = rows.withColumn("h", F.unhex(F.md5(F.array_join(F.col("v").cast("array<string>"), ","))))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"))
    most = size.orderBy(F.desc("n"), "d").first()
    spark = vectors.sparkSession
    if most is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    work = Workspace(spark)
    rows = rows.filter(F.size("v") == most["d"])
    # Equal vectors are known by the least of their ids.
    ids = rows.select("h", "vec_id").distinct()
    few = ids.withColumn("_n", F.row_number().over(W.partitionBy("h").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    few = work.keep(few.groupBy("h").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "ids")
    asked = ids.filter(F.col("vec_id") % query_every == 0).join(few.select("h", "id"), "h").select(F.col("vec_id").alias("query_id"), "id")
    number = "float" if single else "double"  # floats lose nothing as they are, and are half as long
    points = rows.groupBy("h").agg(F.first("v").cast(f"array<{number}>").alias("v")).join(few.select("h", "id"), "h")
    points = points.join(asked.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left")
    points = work.keep(points.select("id", "v", F.coalesce("asked", F.lit(False)).alias("asked")), "vectors")
    total, queries = points.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    sample = np.array([r["v"] for r in points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], float)
    curves, width = fit_curves(sample, float(np.sqrt(most["m"])), recall, min(k / total, 1.0))
    shared = spark.sparkContext.broadcast(curves)
    dtype = np.float32 if single else np.float64

    def keyed(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        asked_at = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
        at, role = np.concatenate([np.arange(n), asked_at]), np.concatenate([np.zeros(n, bool), np.ones(len(asked_at), bool)])
        keys = np.hstack([shared.value.keys(v, False), shared.value.keys(v[asked_at], True)]) if n else np.zeros((CURVES, 0), np.int64)
        c = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(c), len(at)).astype(np.int32)), pa.array(keys.ravel()), pa.array(np.tile(role, c)), b.column(0).take(pa.array(np.tile(at, c)))], ["curve", "key", "query", "id"])

    # Places on the curves are found without the vectors, which join when rows are dealt into blocks.
    placed = arrow_map(points.select("id", "v", "asked"), keyed, "curve int, key long, query boolean, id long")
    placed = placed.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    placed = work.keep(placed.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "curves")
    parts = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("curve", "part", (F.col("first") - before).alias("base"))
    # Of a curve's places the queries are a part; a window reaches over them as well.
    n = total + queries
    half = max(1, int(np.ceil(n * width / 2)))
    size = max(64, min(2 * half, BLOCK))
    groups = max(1, int(np.ceil((2 * half + size) * queries / n / BLOCK_QUERIES)))
    ranked = placed.join(parts, ["curve", "part"]).select("curve", "query", "id", (F.col("pos") - F.col("base")).alias("place"))
    first = F.greatest(F.floor((F.col("place") - half) / size), F.lit(0)).cast("long")
    last = F.floor(F.least(F.col("place") + half, F.lit(n - 1)) / size).cast("long")
    blocks = F.when(F.col("query"), F.sequence(first, last)).otherwise(F.array(F.floor(F.col("place") / size).cast("long")))
    # The queries of a block are dealt into groups; its rows meet each of them.
    group = F.when(F.col("query"), F.array(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(groups - 1)))
    raw = arrow_map(points.select("id", "v"), lambda b: packed(b, dtype), "id long, raw binary")
    dealt = ranked.select("curve", "query", "id", "place", F.explode(blocks).alias("block"), group.alias("group")).select("*", F.explode("group").alias("g"))
    dealt = dealt.select("query", "id", "place", F.xxhash64("curve", "block", "g").alias("_cell")).join(raw, "id")
    found = by_cell(dealt, ["query", "id", "place", "raw"], "q long, id long, score double", lambda rows: nearest(rows, k + 1, half, dtype))
    found = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    shortlist = found.join(few, "id").select("q", "score", F.explode("ids").alias("vec_id")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    shortlist = shortlist.groupBy("q").agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))
    # A query leaves its own id out; what is left is in order, and at most k.
    joined = asked.join(shortlist, asked["id"] == shortlist["q"])
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    ordered = F.slice(F.array_sort(F.transform(own, lambda x: F.struct((-x["score"]).alias("s"), x["vec_id"].alias("vec_id")))), 1, k)
    out = joined.select("query_id", F.posexplode(ordered).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def packed(b: pa.RecordBatch, dtype: type) -> pa.RecordBatch:
    """(id, the bytes of the vector)."""
    v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(b.num_rows, -1)
    return pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "raw"])


def nearest(rows: list[tuple], want: int, half: int, dtype: type) -> list[tuple[int, int, float]]:
    """(query, id, inner product): the best ``want`` rows of a cell for each of its queries, ties to the smaller id.

    ``rows``: (is it a query, id, place, vector). Queries are taken in the order of their places, close ones at once, with
    the rows that lie at most ``half`` places off any of them.
    """
    base, queries = (sorted((r for r in rows if bool(r[0]) == q), key=lambda r: r[2]) for q in (False, True))
    if not base or not queries:
        return []
    x = np.frombuffer(b"".join(r[3] for r in base), dtype).reshape(len(base), -1).astype(float)
    ids, places = np.array([r[1] for r in base]), np.array([r[2] for r in base])
    out = []
    at = 0
    while at < len(queries):
        part = [r for r in queries[at : at + AT_ONCE] if r[2] <= queries[at][2] + half // 4]
        at += len(part)
        low, high = np.searchsorted(places, [part[0][2] - half, part[-1][2] + half + 1])
        count = min(want, int(high - low))
        if not count:
            continue
        q = np.frombuffer(b"".join(r[3] for r in part), dtype).reshape(len(part), -1).astype(float)
        products = q @ x[low:high].T
        least = np.partition(products, high - low - count, axis=1)[:, high - low - count]
        for i, r in enumerate(part):
            # Products of the block are close, not exact: those near the last place are all computed again.
            near = low + np.flatnonzero(products[i] >= least[i] - 1e-9 * (1 + abs(least[i])))
            exact = (x[near] * q[i]).sum(axis=1)
            for j in np.lexsort((ids[near], -exact))[:count]:
                out.append((r[1], int(ids[near[j]]), float(exact[j])))
    return out
