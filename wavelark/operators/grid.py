"""The regular grid of each series: its period, its positions, and the observations on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..sources.workspace import Workspace
from . import select

#: Positions of a series that are made and handled together, so that one long series is many tasks.
CHUNK = 65_536


def estimate_periods(prepared: DataFrame, series_cols: Sequence[str], axis: Axis) -> DataFrame:
    """(``series_cols``, period): the exact median of the positive gaps between neighbouring times; whole microseconds on time axes.

    Gaps are found within spans of a bounded number of rows and between their ends; the median is followed down a tree of
    counts. Neither takes a whole series into one task.
    """
    keys = list(series_cols)
    gaps = select.gaps(prepared, keys, "t").filter("gap < double('infinity')")
    return select.medians(gaps, keys, "gap", axis.timed).withColumnRenamed("median", "period")


def bounds(prepared: DataFrame, series_cols: Sequence[str], axis: Axis, period: int | float | None) -> DataFrame:
    """(``series_cols``, t0, period, n): start, period and number of grid positions of each series.

    Raises where a period cannot be inferred, a time is null or not finite, there is no row at all, or, for a given period
    of a time axis, a time lies off the grid: all found in one pass, as ``prepared`` has each time once.
    """
    bad = F.col("t").isNull() | (F.lit(False) if axis.timed else F.isnan("t") | (F.abs("t") == float("inf")))
    ends = prepared.groupBy(*series_cols).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count_if(bad).alias("bad"), F.count("t").alias("times"), *_phases(axis, period))
    if period is None:
        ends = ends.join(estimate_periods(prepared, series_cols, axis), list(series_cols), "left") if series_cols else ends.join(F.broadcast(estimate_periods(prepared, [], axis)), how="left")
        ends = Workspace(prepared.sparkSession).keep(ends, "bounds")  # a row for each series; each later step would find the median anew
    else:
        ends = ends.withColumn("period", F.lit(period))
    off = F.count_if(F.col("low") != F.col("high")) if {"low", "high"} <= set(ends.columns) else F.lit(0)
    found = ends.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count_if(F.expr("times < 1 AND bad = 0")).alias("none"), F.count_if(F.expr("times < 2")).alias("few"), F.count_if(F.expr("period IS NULL OR period <= 0")).alias("open"), off.alias("off")).first()
    if found["bad"]:
        raise ValueError("a time is null" if axis.timed else "a place on the numeric axis is null, infinite or no number")
    if not found["rows"] or found["none"]:
        raise ValueError("there are no rows")
    if period is None and found["few"]:
        raise ValueError("a sampling period can be inferred from two distinct times or more only")
    if period is None and found["open"]:
        raise ValueError("no positive sampling period fits the times")
    grids = ends.select(*series_cols, "t0", "period", (_steps(axis) + 1).cast("long").alias("n"))
    if found["off"]:
        refuse_off_grid(prepared, grids, series_cols, axis)
    return grids


def _steps(axis: Axis) -> Column:
    return F.expr("(t1 - t0) div period") if axis.timed else F.floor((F.col("t1") - F.col("t0")) / F.col("period"))


def _phases(axis: Axis, period: int | float | None) -> list[Column]:
    """The least and the largest rest of the times by a given period: they differ if a time lies off the grid."""
    if not axis.timed or period is None:
        return []
    rest = F.pmod(F.col("t"), F.lit(period))
    return [F.min(rest).alias("low"), F.max(rest).alias("high")]


def time_at(pos: Column) -> Column:
    return F.col("t0") + pos * F.col("period")


def placed(prepared: DataFrame, grids: DataFrame, series_cols: Sequence[str], axis: Axis) -> DataFrame:
    """Observations with the nearest position and whether they lie exactly on it."""
    rows = prepared.join(grids, list(series_cols)) if series_cols else prepared.crossJoin(F.broadcast(grids))
    pos = F.expr("(t - t0) div period") if axis.timed else F.rint((F.col("t") - F.col("t0")) / F.col("period")).cast("long")
    rows = rows.withColumn("pos", pos)
    return rows.withColumn("aligned", (F.col("t") == time_at(F.col("pos"))) & F.col("pos").between(0, F.col("n") - 1))


def refuse_off_grid(prepared: DataFrame, grids: DataFrame, series_cols: Sequence[str], axis: Axis) -> None:
    """A time that is not exactly on the grid is an error; it is never moved."""
    off = placed(prepared, grids, series_cols, axis).filter("NOT aligned").select(axis.decode(F.col("t")).alias("t")).orderBy("t").limit(3).collect()
    if off:
        raise ValueError(f"times are not exactly aligned to the grid, such as {', '.join(str(r['t']) for r in off)}: give a period that fits them, or resample the series first")


def regularize(prepared: DataFrame, series_cols: Sequence[str], axis: Axis, period: int | float | None = None) -> tuple[DataFrame, DataFrame]:
    """(``series_cols``, pos, t, signal, observed) for every position of every grid, and the grids."""
    grids = bounds(prepared, series_cols, axis, period)
    if period is None or not axis.timed:  # else the bounds have told
        refuse_off_grid(prepared, grids, series_cols, axis)
    found = placed(prepared, grids, series_cols, axis).select(*series_cols, "pos", "signal", "observed")
    chunks = grids.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))))
    chunks = chunks.repartition(*series_cols, "chunk")
    last = F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1
    grid = chunks.withColumn("pos", F.explode(F.sequence(F.col("chunk") * CHUNK, last)))
    grid = grid.select(*series_cols, "pos", time_at(F.col("pos")).alias("t"))
    rows = grid.join(found, [*series_cols, "pos"], "left")
    return rows.select(*series_cols, "pos", "t", "signal", F.coalesce("observed", F.lit(False)).alias("observed")), grids
