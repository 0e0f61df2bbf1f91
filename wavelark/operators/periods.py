"""Periods of a fixed length around groups of suspicious windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.folds import gathered
from .grid import CHUNK

NEEDED = {"grid_start", "grid_stop", "accepted", "suspicious"}
METADATA = ["period_id", "source_window_ids", "anomaly_grid_start", "anomaly_grid_stop", "anomaly_samples", "period_grid_start", "period_grid_stop", "period_samples", "start_time", "end_time", "accepted", "rejection_reason"]
PERIOD = ["period_id", "grid_start", "grid_stop", "time", "signal", "observed_mask", "interpolated_mask", "anomaly_mask", "source_window_ids"]


def suspicious_groups(result: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """(``series_cols``, period_id, source_window_ids, anomaly_grid_start, anomaly_grid_stop): suspicious windows that
    overlap or touch form a group; groups are numbered from 0 in each series.

    Windows are first joined within chunks of positions; only what that leaves, a row for each group of a chunk, is then
    joined and numbered along the series.
    """
    if missing := NEEDED - set(result.columns):
        raise ValueError(f"the result has missing columns: {', '.join(sorted(missing))}")
    odd = result.filter(F.coalesce("suspicious", F.lit(False))).select(*series_cols, "window_id", "grid_start", "grid_stop", "accepted")
    if not odd.filter(~F.coalesce("accepted", F.lit(False))).isEmpty():
        raise ValueError("a suspicious window cannot be rejected")
    chunk = F.floor(F.col("grid_start") / CHUNK).cast("long")
    parts = _touching(odd.withColumn("_chunk", chunk), [*series_cols, "_chunk"], "_part").groupBy(*series_cols, "_chunk", "_part")
    parts = parts.agg(F.collect_list(F.struct("grid_start", "window_id")).alias("_windows"), F.min("grid_start").alias("grid_start"), F.max("grid_stop").alias("grid_stop"))
    windows = F.sort_array(F.flatten(F.collect_list("_windows")))["window_id"]
    groups = _touching(parts, list(series_cols), "period_id").groupBy(*series_cols, "period_id")
    return groups.agg(windows.alias("source_window_ids"), F.min("grid_start").alias("anomaly_grid_start"), F.max("grid_stop").alias("anomaly_grid_stop"))


def _touching(spans: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the number, from 0 within ``keys``, of the group of spans that overlap or touch."""
    order = W.partitionBy(*keys).orderBy("grid_start")
    reach = F.max("grid_stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce((F.col("grid_start") > reach).cast("long"), F.lit(0))
    return spans.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(order)).drop("_opens")


#: Positions of a block that windows are merged in.
BLOCK = 4096


def merged_blocks(result: DataFrame, windows: DataFrame, series_cols: Sequence[str] = (), needed: DataFrame | None = None) -> DataFrame:
    """(``series_cols``, block, samples): the merged samples of accepted windows, an array for each block of positions in
    which there are any; only those of ``needed`` (``series_cols``, block), if that is given.

    A window goes to each block it lies in with its part of the arrays, so what is shuffled is windows. A block is folded
    once, in the order of positions: what the next window cannot hold is put out, the rest is merged with it. The window
    with the least id gives time and signal, masks are joined by or, and ``bad`` tells a sample that differs in time, or in
    signal by more than rounding, from what was there.
    """
    keys = [*series_cols, "window_id"]
    rows = windows.join(result.select(*keys, "grid_start"), keys)
    size, start = F.size("time"), F.col("grid_start")
    rows = rows.filter(size > 0).withColumn("block", F.explode(F.sequence(F.floor(start / BLOCK), F.floor((start + size - 1) / BLOCK))))
    if needed is not None:
        rows = rows.join(needed, [*series_cols, "block"], "left_semi")
    first = F.greatest(start, F.col("block") * BLOCK)
    stop = F.least(start + size, (F.col("block") + 1) * BLOCK)
    part = F.slice(F.arrays_zip("time", "signal", "observed_mask", "interpolated_mask"), (first - start + 1).cast("int"), (stop - first).cast("int"))
    rows = rows.select(*series_cols, "block", first.alias("first"), "window_id", part.alias("part"))
    grouped = rows.groupBy(*series_cols, "block").agg(F.sort_array(F.collect_list(F.struct("first", "window_id", "part"))).alias("_windows"))
    time = windows.schema["time"].dataType.elementType.simpleString()
    id_type = windows.schema["window_id"].dataType.simpleString()
    kind = f"struct<pos:bigint,window_id:{id_type},time:{time},signal:double,observed:boolean,interpolated:boolean,bad:boolean>"
    none = F.expr(f"cast(array() AS array<{kind}>)")

    def samples(window: Column) -> Column:
        return F.transform(window["part"], lambda s, i: F.struct((window["first"] + i).alias("pos"), window["window_id"].alias("window_id"), s["time"].alias("time"), s["signal"].alias("signal"), s["observed_mask"].alias("observed"), s["interpolated_mask"].alias("interpolated"), F.lit(False).alias("bad")))

    def merge(old: Column, new: Column) -> Column:
        near = F.abs(old["signal"] - new["signal"]) <= 1e-12 + 1e-12 * F.abs(old["signal"])
        same = F.coalesce((old["time"] == new["time"]) & ~F.isnan(old["signal"]) & ~F.isnan(new["signal"]) & ((old["signal"] == new["signal"]) | near), F.lit(False))
        own = old["window_id"] <= new["window_id"]
        return F.struct(old["pos"].alias("pos"), F.least(old["window_id"], new["window_id"]).alias("window_id"), old["time"].alias("time"), F.when(own, old["signal"]).otherwise(new["signal"]).alias("signal"), (old["observed"] | new["observed"]).alias("observed"), (old["interpolated"] | new["interpolated"]).alias("interpolated"), (old["bad"] | ~same).alias("bad"))

    def step(tail: Column, window: Column) -> tuple[Column, Column]:
        new = samples(window)
        past = F.when(F.size(tail) > 0, F.least(F.size(tail).cast("long"), window["first"] - F.get(tail, F.lit(0))["pos"])).otherwise(F.lit(0)).cast("int")
        shared = F.least(F.size(tail) - past, F.size(window["part"]))
        both = F.zip_with(F.slice(tail, past + 1, shared), F.slice(new, F.lit(1), shared), merge)
        beyond = F.concat(F.slice(tail, past + shared + 1, F.size(tail) - past - shared), F.slice(new, shared + 1, F.size(window["part"]) - shared))
        return F.concat(both, beyond), F.slice(tail, F.lit(1), past)

    return grouped.select(*series_cols, "block", gathered(F.col("_windows"), none, kind, step, lambda tail: tail).alias("samples"))


def refuse_inconsistent(result: DataFrame, windows: DataFrame, series_cols: Sequence[str] = ()) -> None:
    """Windows that the result does not have, and samples of one position that differ, are errors: one job tells both."""
    keys = [*series_cols, "window_id"]
    unknown = windows.select(*keys).join(result.select(*keys), keys, "left_anti").select(F.lit(True).alias("unknown"), "window_id")
    differs = merged_blocks(result, windows, series_cols).filter(F.exists("samples", lambda s: s["bad"])).select(F.lit(False).alias("unknown"), F.get("samples", F.lit(0))["window_id"].alias("window_id"))
    found = unknown.union(differs).orderBy(F.desc("unknown"), "window_id").limit(1).collect()
    if found and found[0]["unknown"]:
        raise ValueError(f"samples of an unknown window id: the result has no window {found[0]['window_id']}")
    if found:
        raise ValueError("the samples of overlapping windows are inconsistent: two differ in time or signal at one position")


def sample_index(result: DataFrame, windows: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """(``series_cols``, pos, time, signal, observed, interpolated): every position of an accepted window once.

    The first window that holds it gives time and signal, masks are joined by or. Windows that the result does not have, and
    samples of one position that differ in time, or in signal by more than rounding, are errors.
    """
    refuse_inconsistent(result, windows, series_cols)
    rows = merged_blocks(result, windows, series_cols).select(*series_cols, F.explode("samples").alias("_s"))
    return rows.select(*series_cols, *[F.col(f"_s.{c}").alias(c) for c in ("pos", "time", "signal", "observed", "interpolated")])


def prepare_analysis_periods(result: DataFrame, windows: DataFrame, *, period_size: int, series_cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(metadata of all periods, samples of the accepted ones). A period begins with its group and runs ``period_size`` on.

    All windows are checked; only those in blocks that a period needs are merged.
    """
    if period_size < 2:
        raise ValueError(f"a period needs two samples or more, period_size is {period_size}")
    groups = suspicious_groups(result, series_cols)
    refuse_inconsistent(result, windows, series_cols)
    keys = [*series_cols, "period_id"]
    start, stop = F.col("anomaly_grid_start"), F.col("anomaly_grid_stop")
    wanted = groups.select(*keys, start, stop, F.explode(F.sequence(F.floor(start / BLOCK), F.floor((start + period_size - 1) / BLOCK))).alias("block"))
    blocks = merged_blocks(result, windows, series_cols, wanted.select(*series_cols, "block").distinct())
    found = wanted.join(blocks, [*series_cols, "block"])
    own = F.filter("samples", lambda s: (s["pos"] >= start) & (s["pos"] < start + period_size))
    own = F.transform(own, lambda s: F.struct(*[s[c].alias(c) for c in ("pos", "time", "signal", "observed", "interpolated")], (s["pos"] < stop).alias("anomaly")))
    found = found.groupBy(*keys).agg(F.flatten(F.sort_array(F.collect_list(F.struct("block", own.alias("part"))))["part"]).alias("_s"))
    rows = groups.join(found, keys, "left")
    at = lambda pos: F.get(F.filter("_s", lambda x: x["pos"] == pos), F.lit(0))["time"]
    rows = rows.withColumn("anomaly_samples", stop - start).withColumn("period_grid_start", start).withColumn("period_grid_stop", start + period_size)
    reason = F.when(F.col("anomaly_samples") > period_size, "anomaly_group_too_long").when(F.coalesce(F.size("_s"), F.lit(0)) < period_size, "insufficient_following_valid_data")
    rows = rows.withColumn("period_samples", F.lit(period_size)).withColumn("start_time", at(start)).withColumn("end_time", at(start + period_size - 1))
    rows = rows.withColumn("rejection_reason", reason).withColumn("accepted", F.col("rejection_reason").isNull())
    part = lambda name: F.col(f"_s.{name}")
    kept = rows.filter("accepted").select(*keys, F.col("period_grid_start").alias("grid_start"), F.col("period_grid_stop").alias("grid_stop"), part("time").alias("time"), part("signal").alias("signal"), part("observed").alias("observed_mask"), part("interpolated").alias("interpolated_mask"), part("anomaly").alias("anomaly_mask"), "source_window_ids")
    return rows.select(*series_cols, *METADATA), kept.select(*series_cols, *PERIOD)
