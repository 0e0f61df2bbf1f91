"""A corpus pipeline of five stages: toxicity, line dedup, n-gram Jaccard join, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; the driver of a run writes each result as Parquet and reads it again for the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.llm import common, linededup, ngramjoin, packing, pii, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now; null where the text is null."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go. It learns from the labels whose documents are there."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(docs, labels, COLUMNS).filter(~F.col("is_toxic")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go, save in one; a document that has lost all its text goes with them."""
    kept = linededup.dedup_lines(docs, keep_columns=["doc_id", "lang", "source"])
    kept = kept.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return with_length(kept.withColumn("n_chars", F.lit(0).cast("long")))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least doc_id stays."""
    return ngramjoin.keep_one(docs, COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; all documents stay."""
    return with_length(pii.redact(docs, COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, placed in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("ngram_join", copies),
    ("pii", private),
    ("packing", packed),
]

#: The chain of linear models and the boosted trees are beyond SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs, name)
    return docs
