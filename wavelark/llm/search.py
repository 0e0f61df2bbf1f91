"""Ranked lexical search by three-phase uniform thresholds (TPUT) over postings that are partitioned by term.

Phase 1 fetches the head of each list and takes, for each item, the k-th best sum of what heads say as a bound. Phase 2
fetches from each list all entries of at least an equal share of that bound and adds them up, which gives a better
bound and, with what unseen lists can add at most, the candidates. Phase 3 looks the candidates up in every list. Results
are exact: no list is cut at a length, and no document is dropped that could be among the best.

A posting holds a saturation, which depends on the document alone; a list's weight multiplies all its entries, so lists
are in the order of their scores without the weight, and weights travel with the items' terms only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace

#: Bytes that terms are made of: digits, letters, and all beyond ASCII. A-Z become lower case, the rest parts terms.
TERM_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in TERM_BYTES else 32 for c in range(256))
#: Up to so many distinct terms of the items go to the executors as one table; with more, postings of all terms are joined.
VOCABULARY = 500_000
#: Entries that a bucket of documents has on average where phase 2 adds up, and items that it adds up for at a time.
BUCKET_ENTRIES, BLOCK_ITEMS = 1_000_000, 1000


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(FOLD).split()


def forward(docs: DataFrame, known: list[str] | None) -> DataFrame:
    """(key, doc_id, n, terms, times) of each row: its number of terms, and the distinct ones among ``known`` (all, if
    None) with how often they occur. Known terms are told by their place."""
    own = docs.schema["doc_id"].dataType.simpleString()
    kind = "binary" if known is None else "int"
    spark = docs.sparkSession
    shared = None if known is None else spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None if shared is None else {t.encode(): i for i, t in enumerate(shared.value)}
        for b in batches:
            n, sizes, found, times = [], [0], [], []
            for text in b.column(1).cast(pa.binary()):
                words = terms(text.as_py() or b"")
                n.append(len(words))
                for word, tf in Counter(words).items():
                    at = word if place is None else place.get(word)
                    if at is not None:
                        found.append(at)
                        times.append(tf)
                sizes.append(len(found))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((found, pa.binary() if place is None else pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {own}, n long, terms array<{kind}>, times array<long>")
    return rows.withColumn("key", F.monotonically_increasing_id())


def asked_terms(queries: DataFrame, item: str) -> DataFrame:
    """(query, item_id, term): the distinct terms of each row of the queries, which is a query of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [sorted({t.decode() for t in terms(x.as_py() or b"")}) for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.string()))], ["item_id", "terms"])

    rows = queries.select(item, "text").mapInArrow(run, f"item_id {queries.schema[item].dataType.simpleString()}, terms array<string>")
    rows = rows.withColumn("query", F.monotonically_increasing_id())
    return rows.select("query", "item_id", F.explode("terms").alias("term"))


@lru_cache(maxsize=1)
def _group_type() -> pa.Schema:
    return pa.schema([("query", pa.int64()), ("key", pa.int64()), ("partial", pa.int64()), ("most", pa.int64())])


def add_up(entries: pa.Table, lists: pa.Table, k: int) -> pa.Table:
    """Of one bucket of documents and one block of queries: (query, key, partial, most) of the documents that may be among
    the ``k`` best. ``partial`` is what the fetched entries give, ``most`` what the others could add besides."""
    empty = _group_type().empty_table()
    if not entries.num_rows or not lists.num_rows:
        return empty
    code, sat, key = (entries[c].to_numpy() for c in ("code", "sat", "key"))
    order = np.argsort(code, kind="stable")
    code, sat = code[order], sat[order]
    keys, doc = np.unique(key, return_inverse=True)
    doc = doc[order]
    query, codes, least, weight, bound, share, many = (lists[c].to_numpy() for c in ("query", "code", "least", "weight", "bound", "share", "many"))
    order = np.argsort(query, kind="stable")
    starts, stops = np.searchsorted(code, codes, "left"), np.searchsorted(code, codes, "right")
    out = []
    for own in np.split(order, np.flatnonzero(np.diff(query[order])) + 1):
        total, seen = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        for i in own:
            part = slice(starts[i], stops[i])
            high = sat[part] >= least[i]
            at = doc[part][high]  # a list has a document once
            total[at] += sat[part][high] * float(weight[i])  # whole numbers far below 2**53
            seen[at] += 1
        first = own[0]
        unseen = max(int(share[first]) - 1, 0)
        most = total + (many[first] - seen) * float(unseen)
        bar = float(bound[first])
        if len(keys) >= k:
            bar = max(bar, np.partition(total, len(keys) - k)[len(keys) - k])
        good = np.flatnonzero((seen > 0) & (most >= bar))
        out.append(pa.table([np.full(len(good), query[first]), keys[good], total[good].astype(np.int64), most[good].astype(np.int64)], schema=_group_type()))
    return pa.concat_tables(out)


def kth(rows: DataFrame, group: str, value: str, k: int, name: str) -> DataFrame:
    """(group, name): the k-th highest value of each group, 0 where it has fewer."""
    best = rows.withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc(value)))).filter(F.col("_rank") <= k)
    return best.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("_rank") == k, F.col(value))), F.lit(0).cast("long")).alias(name))


def search(docs: DataFrame, queries: DataFrame, k: int = 50, item: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each row of ``queries``, scores above 0 only.

    Terms, weights and scores are whole numbers as the module's formulas say: with N documents that have a term, L terms in
    all, n terms in a document, df documents of a term and tf its times in a document, its weight is floor(1000 * ln((2N + 2)
    / (2 df + 1))), and a document gets weight * ((10**9 * tf) div (1000 * tf + 20 * m)) with m = 50 + (50 * n * N) div L.
    Equal scores go by doc_id, null last. A null text has no terms; a query without known terms has no rows. Each row is a
    document, and each row of ``queries`` a query, of its own, whatever its id; other columns may have any names.
    Where very many documents tie at the last place, all of them are looked up.
    """
    work = Workspace(docs.sparkSession)
    asked = work.keep(asked_terms(queries, item), "asked")
    distinct = asked.select("term").distinct()
    known = sorted(r["term"] for r in distinct.collect()) if distinct.count() <= VOCABULARY else None
    index = work.keep(forward(docs, known), "forward")
    totals = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("entries")).first()
    n_docs, words = totals["docs"], max(totals["words"], 1)

    entry = F.explode(F.arrays_zip("terms", "times"))
    rows = index.withColumn("m", 50 + F.expr(f"(50 * n * {n_docs}L) div {words}L")).select("key", "m", entry.alias("x")).select("key", "m", F.col("x.terms").alias("term"), F.col("x.times").alias("tf"))
    if known is None:
        coded = work.keep(distinct.select("term", F.monotonically_increasing_id().alias("code")), "codes")
        rows = rows.withColumn("term", F.decode("term", "UTF-8")).join(coded, "term")
        asked = asked.join(coded, "term")
    else:
        places = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(known)], "code int, term string")
        rows, asked = rows.withColumnRenamed("term", "code"), asked.join(places, "term")
    rows = rows.select("code", F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)").alias("sat"), "key")
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(totals["entries"] / (2 * BUCKET_ENTRIES)))
    lists = work.keep(rows.repartitionByRange(parts, "code", F.desc("sat"), "key").sortWithinPartitions("code", F.desc("sat"), "key"), "postings")

    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = lists.groupBy("code").agg(F.count(F.lit(1)).alias("df")).select("code", weight.alias("weight")).filter("weight > 0")
    many = F.count(F.lit(1)).over(W.partitionBy("query"))
    own = work.keep(asked.join(weights, "code").select("query", "code", "weight", many.alias("many")), "weights")

    ranked = F.row_number().over(W.partitionBy("code").orderBy(F.desc("sat"), "key"))
    heads = lists.withColumn("_rank", ranked).filter(F.col("_rank") <= k)
    sums = heads.join(own, "code").groupBy("query", "key").agg(F.sum(F.col("weight") * F.col("sat")).alias("partial"))
    bounds = kth(sums, "query", "partial", k, "bound")

    share = F.ceil(F.col("bound") / F.col("many")).cast("long")
    own = own.join(bounds, "query").withColumn("share", share).withColumn("least", F.ceil(F.col("share") / F.col("weight")).cast("long"))
    blocks = max(1, math.ceil(asked.select("query").distinct().count() / BLOCK_ITEMS))
    own = work.keep(own.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), "thresholds")
    buckets = max(1, math.ceil(totals["entries"] / BUCKET_ENTRIES))
    cuts = own.groupBy("code", "block").agg(F.min("least").alias("least"))
    fetched = lists.join(cuts, "code").filter("sat >= least").select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "block", "code", "sat", "key")
    everywhere = own.withColumn("in_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).withColumnRenamed("block", "in_block")
    pairs = fetched.groupBy("bucket", "block").cogroup(everywhere.groupBy("in_bucket", "in_block"))
    found = work.keep(pairs.applyInArrow(lambda left, right: add_up(left, right, k), "query long, key long, partial long, most long"), "sums")

    better = kth(found, "query", "partial", k, "better")
    least = F.greatest(F.col("better"), F.col("bound"))
    candidates = found.join(better, "query").join(own.select("query", "bound").distinct(), "query").filter(F.col("most") >= least).select("query", "key")
    exact = candidates.join(own.select("query", "code", "weight"), "query").join(lists, ["code", "key"]).groupBy("query", "key").agg(F.sum(F.col("weight") * F.col("sat")).alias("score"))
    ids = asked.select("query", "item_id").distinct()
    scored = exact.filter("score > 0").join(index.select("key", "doc_id"), "key")
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "key"))
    out = scored.withColumn("rank", best).filter(F.col("rank") <= k).join(ids, "query").select("item_id", "rank", "doc_id", "score")
    out = work.keep(out, "best")
    work.drop(index, lists, found)
    return out
