"""Mixing sources to target weights: hash-random keys, ranges of keys within each source, distributed prefix sums of sizes,
and a cut at each source's exact budget; whole epochs before the last one are taken without looking at the order.

DataFrame functions only; nothing but a row count comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a random key. Its leading bits name the range of keys that a row is summed in.
KEY_BITS = 60
#: Rows that a range of keys has on average, over all sources; the number of ranges follows from it.
RANGE_ROWS = 4_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, size: Column) -> Column:
    """A number of KEY_BITS bits that only the document's id and size decide, so reruns give the same order."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (is_null, source, source_size), one row a source.

    Sources in the order of their code points, null last, have the weights in turn. They share ``share`` times all sizes;
    a target stops at ``most`` times its source's size, and what is beyond is shared by weight among the others, until no
    target is above. That is a water level: sources fill up in the order of limit per weight, and those that are not
    full when the budget is spent stand at the same level.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights are numbers above 0, one at least")
    place = (F.row_number().over(W.orderBy("is_null", "source")) - 1) % len(weights)
    rows = sources.withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place))
    rows = rows.withColumn("_limit", most * F.col("source_size")).withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    order = W.orderBy("_ratio", "is_null", "source")
    full = F.coalesce(F.sum("_limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = share * F.sum("source_size").over(W.partitionBy()) - full
    rows = rows.withColumn("_level", left / F.sum("_weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    open_level = F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(W.partitionBy())  # the first open source has the highest
    target = F.when(F.col("_level") >= F.col("_ratio"), F.col("_limit")).otherwise(F.col("_weight") * open_level)
    return rows.select("is_null", "source", "source_size", target.cast("double").alias("target"))


def plan_mix(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: int = 2, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, size, source_size, target, epochs, extra and taken of every document.

    A document's size is its number of words (null text: 0). A source's whole epochs take all of every document; the rest of
    its budget is taken in the order of the random keys, and the document at the cut gives only its first ``extra`` words,
    so a source's ``taken`` add up to its target, rounded down. ``taken`` is epochs * size + extra and never above
    ``most`` * size. A source without words takes nothing. Rows that agree in doc_id and size may stand for one another. A
    null source is a source, a null doc_id an id. Other columns may have any names.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession)
    size = words(F.col("text"))
    rows = docs.select(F.struct(*keep).alias("kept"), F.col("source").isNull().alias("is_null"), F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("id"), size.alias("size"))
    rows = work.keep(rows.withColumn("key", random_key(F.col("id"), F.col("size"))), "sizes")
    bits = max(0, (rows.count() // RANGE_ROWS).bit_length())
    rows = rows.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    source, part = ["is_null", "source"], ["is_null", "source", "range"]
    sums = work.keep(rows.groupBy(*part).agg(F.sum("size").alias("words")), "ranges")
    goals = targets(sums.groupBy(*source).agg(F.sum("words").alias("source_size")), weights, share, most)
    before = F.coalesce(F.sum("words").over(W.partitionBy(*source).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).join(goals, source)
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.expr("floor(target) div nullif(source_size, 0)"), F.lit(0)).cast("long")
    sums = sums.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")).drop("words")
    inner = W.partitionBy(*part).orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, part)
    extra = F.least(F.greatest(F.col("rest") - F.col("before") - F.col("ahead"), F.lit(0)), F.col("size"))
    ranked = ranked.withColumn("extra", extra)
    taken = F.col("epochs") * F.col("size") + F.col("extra")
    return ranked.select(*[F.col("kept")[k].alias(k) for k in keep], "size", "source_size", "target", "epochs", "extra", taken.alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: int = 2, keep: Sequence[str] = ("doc_id", "text", "source")) -> DataFrame:
    """The mix itself: ``keep`` and ``epoch``, one row for each time a document is taken; the text of a document at a
    source's cut ends with its last word taken. ``keep`` has ``text``."""
    rows = plan_mix(docs, weights, share, most, keep)
    times = F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)
    rows = rows.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    cut = (F.col("epoch") == F.col("epochs")) & (F.col("extra") < F.col("size"))
    # The text up to the end of a word: what stands before the word after it.
    found = F.regexp_replace("text", rf"({WORD})", "$1\x01")
    first = F.regexp_replace(F.call_function("substring_index", found, F.lit("\x01"), F.col("extra").cast("int")), "\x01", "")
    text = F.when(cut, F.when(F.contains("text", F.lit("\x01")), _first_words(F.col("text"), F.col("extra"))).otherwise(first)).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*keep, "epoch")


def _first_words(text: Column, n: Column) -> Column:
    """The first words, one space between them: for texts that hold the mark that ``mix`` cuts at."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), n.cast("int")), " ")
