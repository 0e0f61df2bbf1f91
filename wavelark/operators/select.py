"""Order statistics of very many numbers, and neighbours along a very long axis, without one task that holds a series.

A number is told apart by its digits to the base 2**16, of the order-keeping whole number that stands for it. Counts by
leading digits form a tree whose nodes have at most 65,536 children; the place of a statistic is followed from the root down,
so no task ever sees more than the children of one node, and all series are followed at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGIT, LEVELS = 16, 4


def to_ordered(number: Column) -> Column:
    """A double of 0 or more as the whole number of its bits, which has the same order. By its hexadecimal form."""
    text = F.format_string("%a", number)
    exponent = F.regexp_extract(text, r"p(.*)$", 1).cast("long")
    fraction = F.rpad(F.regexp_extract(text, r"\.([0-9a-f]*)p", 1), 13, "0")
    small = text.startswith("0x0.")
    return F.when(small, F.lit(0).cast("long")).otherwise(exponent + 1023) * (1 << 52) + F.conv(fraction, 16, 10).cast("long")


def ranked_values(values: DataFrame, keys: Sequence[str], value: str, ranks: Column) -> DataFrame:
    """(``keys``, place, ``value``): values of the wanted ranks. ``ranks`` gives an array of ranks, from 0, of ``_n``, the
    number of values of a series; ``place`` is the place in that array. Values are whole numbers of 0 or more."""
    keys = list(keys)
    leaf = values.groupBy(*keys, F.col(value).alias("_node")).agg(F.count(F.lit(1)).alias("_count"))
    tree = [leaf]
    for _ in range(1, LEVELS):
        above = tree[0].groupBy(*keys, F.shiftright("_node", DIGIT).alias("_node")).agg(F.sum("_count").alias("_count"))
        tree.insert(0, above)
    sizes = tree[0].groupBy(*keys).agg(F.sum("_count").alias("_n"))
    wanted = sizes.select(*keys, F.posexplode(ranks).alias("place", "_rank"), F.lit(0).cast("long").alias("_above"))
    for level in tree:
        nodes = level.withColumn("_above", F.shiftright("_node", DIGIT))
        met = wanted.join(nodes, [*keys, "_above"])
        before = F.sum("_count").over(W.partitionBy(*keys, "place").orderBy("_node")) - F.col("_count")
        met = met.withColumn("_before", before).filter((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_count")))
        wanted = met.select(*keys, "place", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_node").alias("_above"))
    return wanted.select(*keys, "place", F.col("_above").alias(value))


def medians(values: DataFrame, keys: Sequence[str], value: str, whole: bool) -> DataFrame:
    """(``keys``, median): the exact median of the positive numbers of each series, rounded down if they are ``whole``."""
    middle = F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2"))
    if whole:
        found = ranked_values(values, keys, value, middle)
        return found.groupBy(*keys).agg(F.expr(f"sum({value}) div 2").alias("median"))
    # The numbers themselves come back by the whole number that stands for them: a power of two times a fraction.
    coded = values.select(*keys, to_ordered(F.col(value)).alias("_bits"))
    found = ranked_values(coded, keys, "_bits", middle).withColumn("_x", from_ordered(F.col("_bits")))
    return found.groupBy(*keys).agg((F.sum("_x") / 2).alias("median"))


def from_ordered(bits: Column) -> Column:
    """The double that ``to_ordered`` made the number of."""
    exponent, fraction = F.shiftright(bits, 52), bits.bitwiseAND(F.lit((1 << 52) - 1))
    base = F.when(exponent == 0, fraction.cast("double")).otherwise((fraction + F.lit(1 << 52)).cast("double"))
    power = F.greatest(exponent, F.lit(1)).cast("int") - 1075
    half = (power / 2).cast("int")  # in two steps: a single power of two may lie below the least double
    return base * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


#: Rows that a span of an axis has at most where it can be divided, and parts that a span is divided into at a time.
SPAN_ROWS, DIVISIONS = 65_536, 2


def divided(rows: DataFrame, keys: Sequence[str], at: str) -> tuple[DataFrame, list[str]]:
    """Adds columns that tell spans of an axis, and their names: spans follow one another in the order of these columns.

    A series is cut into spans of equal length, as many as it has thousands of rows; a span that has still more than
    SPAN_ROWS rows is cut again by its own ends and rows, so bursts are divided too. Places must be distinct for that.
    """
    keys, names = list(keys), []
    for i in range(DIVISIONS):
        part = [*keys, *names]
        most = SPAN_ROWS if i else 0
        ends = rows.groupBy(*part).agg(F.min(at).alias("_t0"), F.max(at).alias("_t1"), F.count(F.lit(1)).alias("_rows"))
        ends = ends.filter(F.col("_rows") > most)
        pieces = F.ceil(F.col("_rows") * 16 / SPAN_ROWS)
        share = (F.col(at) - F.col("_t0")) / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0))
        name = f"_span{i}"
        joined = rows.join(ends, part, "left") if part else rows.join(F.broadcast(ends), how="left")  # one row
        rows = joined.withColumn(name, F.coalesce(F.floor(share * pieces), F.lit(0)).cast("long")).drop("_t0", "_t1", "_rows")
        names.append(name)
    return rows, names


def gaps(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """(``keys``, gap): distances between neighbouring places of each series; within spans, and between spans' ends."""
    keys = list(keys)
    rows, names = divided(rows.select(*keys, at), keys, at)
    own = W.partitionBy(*keys, *names).orderBy(at)
    parts = [rows.select(*keys, (F.col(at) - F.lag(at).over(own)).alias("gap"))]
    ends = rows.groupBy(*keys, *names).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    for i in reversed(range(len(names))):  # ends of the finest spans meet within the span above them, and so on up
        order = W.partitionBy(*keys, *names[:i]).orderBy(names[i])
        parts.append(ends.select(*keys, (F.col("_first") - F.lag("_last").over(order)).alias("gap")))
        ends = ends.groupBy(*keys, *names[:i]).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    return reduce(DataFrame.unionByName, parts).filter("gap > 0")
