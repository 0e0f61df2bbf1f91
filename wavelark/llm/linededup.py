"""Line dedup: explode normalised lines, hash, count distinct documents, drop, reassemble by position."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: What is stripped from both ends of a line to make its key.
BLANKS = b" \t\n\x0b\x0c\r"
#: Parts into which the lines of one key are dealt for the join with the keys to drop.
SALTS = 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None if the key is shorter than ``min_chars`` code points."""
    key = line.strip(BLANKS).lower()  # bytes.lower() touches A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id): each eligible key of each row once."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        keys: list[bytes] = []
        at: list[int] = []
        for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
            if text:
                found = {line_key(x, min_chars) for x in text.split(b"\n") if len(x) >= min_chars}
                found.discard(None)
                keys += found
                at += [i] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0).take(pa.array(at, pa.int64()))], ["key", "doc_id"])

    return arrow_map(docs.select("doc_id", "text"), batch, f"key binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep_columns: list[str] | None = None) -> DataFrame:
    """Drop lines whose key is found in at least ``min_docs`` documents, save in the largest doc_id holding it.

    Returns ``keep_columns`` (default: doc_id), ``text`` (the lines kept, joined by a newline), ``n_lines`` and
    ``n_dropped``. A null or empty text has one empty line and stays empty. Rows that share a doc_id count as one
    document. Rows without a doc_id count as no document and hold no last copy; they lose the lines that go.
    A key shorter than ``min_chars`` never goes, however often it is found. Other columns may have any names.
    """
    kept = keep_columns or ["doc_id"]
    lines = _lines(docs, min_chars)
    frequent = lines.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("holder")).filter(F.col("n") >= min_docs)
    frequent = frequent.select("key", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    gone = dealt.join(frequent, ["key", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    gone = gone.groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_set("key").alias("_gone"))
    inner = docs.select(F.struct(*kept).alias("_kept"), "doc_id", "text")
    joined = inner.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")), "left").select("_kept", "text", "_gone")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_dropped = [], [], []
        for text, drop in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            n = len(lines)
            if drop:
                drop = set(drop)
                lines = [x for x in lines if len(x) < min_chars or line_key(x, min_chars) not in drop]
            n_lines.append(n)
            n_dropped.append(n - len(lines))
            texts.append(text or b"" if n == len(lines) else b"\n".join(lines))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["_kept", "text", "n_lines", "n_dropped"])

    out = arrow_map(joined, batch, f"_kept {inner.schema['_kept'].dataType.simpleString()}, text string, n_lines long, n_dropped long")
    return out.select(*[F.col("_kept")[k].alias(k) for k in kept if k != "text"], "text", "n_lines", "n_dropped")
