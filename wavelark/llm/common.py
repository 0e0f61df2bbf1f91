"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only on a local master (as in tests on one machine) a session may name none: a temporary folder is made and set. On a
    cluster each machine would write into a folder of its own, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wavelark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Tables of one computation, in a folder of their own within the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.used = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it again: lineage ends there."""
        self.used += 1
        path = f"{self.folder}/{self.used}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this workspace that no later step reads: what was made of them is written already."""
        context = self.spark.sparkContext
        for table in tables:
            path = context._jvm.org.apache.hadoop.fs.Path(table.kept_at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df``, written into the shared folder and read again."""
    return Workspace(df.sparkSession).keep(df, name)


#: Rows of a batch that become Python objects at once.
SLICE_ROWS = 1000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, SLICE_ROWS at a time. What Arrow has left over from a batch goes back to the system, as a
    worker is kept for later stages."""
    for b in batches:
        for start in range(0, max(1, b.num_rows), SLICE_ROWS):
            yield b.slice(start, SLICE_ROWS)
        pa.default_memory_pool().release_unused()


def arrow_map(df: DataFrame, batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch of at most SLICE_ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield batch(b)

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, group: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without a task per group.

    ``bucket`` splits a group into many parts. Rows are numbered within (group, bucket), and the part's
    offset is the running sum of the counts of the parts before it. ``df`` is evaluated twice.
    """
    from pyspark.sql import Window as W

    counts = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = W.partitionBy(*group, bucket).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(inner))
    keys = [*group, bucket]
    return ranked.join(offsets, keys).withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_rank", "_before")
