"""Tables that a computation writes into the folder that all executors share, so that lineage ends there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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
