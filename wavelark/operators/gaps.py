"""Runs of missing samples and their bounded linear interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import CHUNK


def missing_runs(regular: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """(``series_cols``, run_start, run_stop): maximal runs of positions without a signal, half open.

    Runs are found within chunks of positions; only those that touch a chunk's edge, two a chunk at most, are then joined
    along the series.
    """
    keys = list(series_cols)
    lost = regular.filter(F.col("signal").isNull()).select(*keys, "pos", F.floor(F.col("pos") / CHUNK).cast("long").alias("_chunk"))
    island = F.col("pos") - F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy("pos"))
    runs = lost.withColumn("_island", island).groupBy(*keys, "_chunk", "_island").agg(F.min("pos").alias("run_start"), (F.max("pos") + 1).alias("run_stop"))
    at_edge = (F.col("run_start") % CHUNK == 0) | (F.col("run_stop") % CHUNK == 0)
    inner = runs.filter(~at_edge).select(*keys, "run_start", "run_stop")
    order = W.partitionBy(*keys).orderBy("run_start")
    opens = F.coalesce(F.col("run_start") != F.lag("run_stop").over(order), F.lit(True)).cast("long")
    edge = runs.filter(at_edge).withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order))
    return inner.union(edge.groupBy(*keys, "_run").agg(F.min("run_start").alias("run_start"), F.max("run_stop").alias("run_stop")).drop("_run"))


def interpolate(regular: DataFrame, series_cols: Sequence[str], max_gap: int) -> DataFrame:
    """Adds ``filled`` and ``interpolated``: runs of at most ``max_gap`` with a signal on both sides are filled whole.

    A filled sample's neighbours are at most ``max_gap`` positions away, so series are cut into chunks and each gets the
    signals that close to its edges from the chunks beside it; no task needs a whole series.
    """
    if max_gap == 0:
        return regular.withColumn("filled", F.col("signal")).withColumn("interpolated", F.lit(False))
    chunk = max(CHUNK, max_gap + 1)
    own = F.floor(F.col("pos") / chunk).cast("long")
    beside = F.array_distinct(F.array(own, F.floor((F.col("pos") - max_gap) / chunk).cast("long"), F.floor((F.col("pos") + max_gap) / chunk).cast("long")))
    dealt = regular.withColumn("_own", own).withColumn("_chunk", F.explode(beside)).filter((F.col("_chunk") == F.col("_own")) | F.col("signal").isNotNull())
    order = W.partitionBy(*series_cols, "_chunk").orderBy("pos")
    held = F.when(F.col("signal").isNotNull(), F.struct("pos", "signal"))
    rows = dealt.withColumn("_a", F.last(held, True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_b", F.first(held, True).over(order.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.filter(F.col("_chunk") == F.col("_own"))
    short = F.coalesce(F.col("signal").isNull() & (F.col("_b.pos") - F.col("_a.pos") - 1 <= max_gap), F.lit(False))
    filled = F.when(short, line(F.col("_a.pos"), F.col("_a.signal"), F.col("_b.pos"), F.col("_b.signal"), F.col("pos"))).otherwise(F.col("signal"))
    return rows.select(*regular.columns, filled.alias("filled"), short.alias("interpolated"))


def line(x0: Column, y0: Column, x1: Column, y1: Column, x: Column) -> Column:
    return F.when(x1 > x0, (y1 - y0) / F.nullif(x1 - x0, F.lit(0)) * (x - x0) + y0)
