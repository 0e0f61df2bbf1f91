"""What the plots show, as rows: where a trace stands (plot_row, panel), its titles, and its points. Drawing is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .analyze import centered, magnitude


def _limited(rows: DataFrame, series_cols: Sequence[str], order: str, most: int | None, name: str) -> DataFrame:
    """The first ``most`` rows of each series, which is a figure of its own."""
    if most is not None and most < 1:
        raise ValueError(f"{name} is a positive number or None")
    if most is None:
        return rows
    if not series_cols:
        return rows.orderBy(order).limit(most)
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*series_cols).orderBy(order))).filter(F.col("_place") <= most).drop("_place")


def _laid_out(chosen: DataFrame, series_cols: Sequence[str], order: str, figure: str) -> DataFrame:
    """Adds plot_row, from 1 in each series' figure, and figure_title, in which ``figure`` has the number of rows."""
    own = W.partitionBy(*series_cols)
    title = F.format_string(figure, F.count(F.lit(1)).over(own))
    return chosen.withColumn("plot_row", F.row_number().over(own.orderBy(order))).withColumn("figure_title", title)


def _window_traces(rows: DataFrame, keep: Sequence[str], show_centered: bool) -> DataFrame:
    samples = rows.select(*keep, F.explode(F.arrays_zip("time", "signal", "observed_mask", "interpolated_mask", "centered")).alias("_s"))
    trace = lambda name, y, on=None: F.when(F.lit(True) if on is None else F.col(f"_s.{on}"), F.struct(F.lit(name).alias("trace"), F.col(f"_s.{y}").alias("y")))
    traces = [trace("regularized signal", "signal"), trace("observed", "signal", "observed_mask"), trace("interpolated", "signal", "interpolated_mask")]
    if show_centered:
        traces.append(trace("centered", "centered"))
    shown = samples.select(*keep, F.col("_s.time").alias("x"), F.explode(F.array_compact(F.array(*traces))).alias("_t"))
    return shown.select(*keep, F.lit("window").alias("panel"), F.col("_t.trace").alias("trace"), "x", F.col("_t.y").alias("y"))


def plot_window(window_id: int, result: DataFrame, windows: DataFrame, *, show_centered: bool = True, series: dict | None = None) -> DataFrame:
    """Traces of one accepted window; of several series, ``series`` names one by the values of its columns."""
    for name, value in (series or {}).items():
        result, windows = (rows.filter(F.col(name).eqNullSafe(F.lit(value))) for rows in (result, windows))
    rows = result.filter(F.col("window_id") == window_id).select("suspicious", "accepted").limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"several series have a window {window_id}: name one by `series`")
    row = rows[0] if rows else None
    if row is None:
        raise KeyError(f"there is no window {window_id}")
    if not row["accepted"]:
        raise ValueError(f"window {window_id} was not accepted, so its signal has gaps")
    title = f"Window {window_id} ({'suspicious' if row['suspicious'] else 'normal'})"
    one = windows.filter(F.col("window_id") == window_id).withColumn("plot_row", F.lit(1)).withColumn("title", F.lit(title))
    return _window_traces(one, ["window_id", "plot_row", "title"], show_centered)


def significant(number: Column) -> Column:
    """A number with three significant digits, without zeros at the end; in exponent form from 1000 on and below 0.0001."""
    short = F.format_string("%.2e", number)
    size = F.regexp_extract(short, r"e(.*)$", 1).try_cast("int")
    plain = F.regexp_replace(short.try_cast("decimal(20, 10)").cast("string"), r"\.?0+$", "")
    long = F.concat(F.regexp_replace(F.regexp_extract(short, r"^(.*)e", 1), r"\.?0+$", ""), F.regexp_extract(short, r"(e.*)$", 1))
    endless = F.when(number > 0, "inf").otherwise("-inf")
    return F.when(number.isNull() | F.isnan(number), "nan").when(F.abs(number) == float("inf"), endless).when(number == 0, "0").when(size.between(-4, 2), plain).otherwise(long)


def top_suspicious(result: DataFrame, max_windows: int | None = None, series_cols: Sequence[str] = ()) -> DataFrame:
    """Suspicious windows in the order of their ids, the first ``max_windows`` of each series."""
    if missing := {"suspicious", "score"} - set(result.columns):
        raise ValueError(f"the result lacks {sorted(missing)}")
    return _limited(result.filter(F.coalesce("suspicious", F.lit(False))), series_cols, "window_id", max_windows, "max_windows")


def plot_suspicious_windows(result: DataFrame, windows: DataFrame, *, show_centered: bool = True, max_windows: int | None = None, series_cols: Sequence[str] = (), required: bool = True) -> DataFrame:
    """Traces of the suspicious windows, one plot row each; titles give id and score. Each series is a figure, with
    ``max_windows`` rows at most. Without suspicious windows there is nothing to plot: an error if one is ``required``, else no
    rows."""
    keys = [*series_cols, "window_id"]
    chosen = top_suspicious(result, max_windows, series_cols).select(*keys, "score")
    if required and chosen.isEmpty():
        raise ValueError("no suspicious window to plot")
    absent = chosen.join(windows, keys, "left_anti").select("window_id").orderBy("window_id").limit(10).collect()
    if absent:
        raise ValueError(f"missing WindowData: the samples of suspicious windows {[r['window_id'] for r in absent]}")
    title = F.concat(F.lit("Suspicious window "), F.col("window_id").cast("string"), F.lit(" — score="), significant(F.col("score")))
    chosen = _laid_out(chosen.withColumn("title", title).drop("score"), series_cols, "window_id", "Energy anomalies (%d windows)")
    return _window_traces(windows.join(chosen, keys), [*keys, "plot_row", "title", "figure_title"], show_centered)


def plot_msst_periods(periods: DataFrame, analyses: DataFrame, *, max_periods: int | None = None, center: bool = True, series_cols: Sequence[str] = (), required: bool = True) -> DataFrame:
    """Per period, three panels: the processed signal with the extent of the anomaly over the time axis (``time``), and the
    magnitudes of both transforms over seconds and frequency (x, y, z). Each series is a figure, with ``max_periods`` periods at
    most. Without analyses: an error if one is ``required``, else no rows."""
    keys = [*series_cols, "period_id"]
    chosen = _limited(analyses.select(*keys).distinct(), series_cols, "period_id", max_periods, "max_periods")
    if required and chosen.isEmpty():
        raise ValueError("no MSST analysis to plot")
    chosen = _laid_out(chosen, series_cols, "period_id", "Fixed-period spectral analysis (%d periods)")
    keep = [*keys, "plot_row", "figure_title"]
    title = lambda panel: F.format_string(f"Period %d — {panel}", "period_id").alias("title")
    signal = centered(F.col("signal")) if center else F.col("signal")
    axis = periods.schema["time"].dataType.elementType
    none = F.lit(None).cast("double")
    trace = lambda name, on: F.when(on, F.lit(name))
    samples = periods.join(chosen, keys).select(*keep, F.explode(F.arrays_zip("time", signal.alias("v"), F.col("anomaly_mask").alias("a"))).alias("_s"))
    names = F.array_compact(F.array(trace("processed signal", F.lit(True)), trace("anomaly extent", F.col("_s.a"))))
    first = samples.select(*keep, title("signal"), F.lit("signal").alias("panel"), F.explode(names).alias("trace"), F.col("_s.time").alias("time"), none.alias("x"), F.col("_s.v").alias("y"), none.alias("z"))
    panels = F.array(*[F.struct(F.lit(n).alias("panel"), F.lit(f"{n} magnitude").alias("trace"), magnitude(n).alias("z"), title(n.upper())) for n in ("stft", "msst")])
    shown = analyses.join(chosen, keys).select(*keep, "spectral_time", "frequency", F.explode(panels).alias("_p"))
    rest = shown.select(*keep, F.col("_p.title").alias("title"), F.col("_p.panel").alias("panel"), F.col("_p.trace").alias("trace"), F.lit(None).cast(axis).alias("time"), F.col("spectral_time").alias("x"), F.col("frequency").alias("y"), F.col("_p.z").alias("z"))
    return first.unionByName(rest)
