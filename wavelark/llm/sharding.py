"""Sharding: weighted rendezvous hashing of stable record keys, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

#: Parts into which each shard is cut for numbering its rows.
SLOT_BUCKETS = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) with the best score for this key.

    The score of shard s is ``-ln(u) / weight`` with u in (0, 1) from a hash of (key, s); the least wins and
    ties go to the smaller shard. A further shard only takes rows for which its own score is the least, and a
    larger weight only takes rows, so no row moves between other shards.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("each shard needs a weight above 0")
    unit = [(F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11) + 0.5) / float(2**53) for s in range(len(weights))]
    scores = [F.struct((-F.log(u) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard")) for s, (u, w) in enumerate(zip(unit, weights, strict=True))]
    return F.array_min(F.array(*scores))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, size and slot for every row; ``grown_shard`` is the shard under ``grown_weights``.

    Null keys are one key like any other, so their rows share a shard. Rows with the same key share a shard and
    get different slots. A null text has size 1 and the checksum of no bytes. An empty table gives no rows.
    Other columns of the input are not read, whatever their names.
    """
    grown = list(grown_weights) if grown_weights is not None else [*weights, 1.0]
    named = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        rendezvous(named, weights).alias("shard"),
        rendezvous(named, grown).alias("grown_shard"),
    ).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SLOT_BUCKETS)))
    out = numbered(rows, ["shard"], "_bucket", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
