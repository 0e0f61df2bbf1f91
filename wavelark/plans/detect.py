"""The first stage: windows of each series scored by their local energy."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import Options
from ..functions.tapers import checked
from ..operators import gaps, grid, prepare, score, windows

RESULT = ["window_id", "start_time", "end_time", "grid_start", "grid_stop", "expected_samples", "observed_samples", "interpolated_samples", "valid_ratio", "longest_missing_run", "accepted", "rejection_reason", "energy", "baseline", "mad", "robust_scale", "score", "suspicious"]
WINDOW_DATA = ["window_id", "time", "signal", "centered", "windowed", "observed_mask", "interpolated_mask"]


def detect_energy_anomalies(
    data: DataFrame,
    *,
    time_col: str = "time",
    value_col: str = "value",
    series_cols: Sequence[str] = (),
    quality_col: str | None = None,
    valid_quality_flags: Iterable | None = None,
    order_col: str | None = None,
    sampling_period: timedelta | str | float | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(result, windows) for every series: scores of all windows, and the samples of the accepted ones.

    Options are those of ``Options``. Values that are unavailable are null. A series is told apart by ``series_cols``; without
    any, all rows are one series. Result and window data share a table of windows: persist what is used more than once. Where
    windows overlap so much that a sample lies in many, the result comes from whole blocks of windows.
    """
    o = Options(**options)
    prepared, axis = prepare.prepare(data, time_col, value_col, series_cols, quality_col, valid_quality_flags, order_col)
    period = None if sampling_period is None else axis.period(sampling_period)
    taper = checked(o.window_name, o.window_size)
    regular, _ = grid.regularize(prepared, series_cols, axis, period)
    filled = gaps.interpolate(regular, series_cols, o.max_interpolation_gap)
    measured = windows.measured(filled, series_cols, axis, o, taper)
    if windows.is_dense(o):
        counted = windows.measured_densely(filled, series_cols, axis, o)
    else:
        counted = measured.withColumn("start_time", F.get("time", F.lit(0))).withColumn("end_time", F.get("time", F.lit(o.window_size - 1)))
    keys = [*series_cols, "window_id"]
    scored = score.score(counted.filter("accepted").select(*keys, "energy"), series_cols, o)
    result = counted.join(scored.drop("energy"), keys, "left")
    result = result.withColumn("suspicious", F.coalesce("suspicious", F.lit(False)))
    return result.select(*series_cols, *RESULT), measured.filter("accepted").select(*series_cols, *WINDOW_DATA)
