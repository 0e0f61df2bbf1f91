"""The first stage as a stateful stream: windows are scored as soon as the watermark has passed what they need."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import astuple
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.axis import Axis
from ..functions.checks import Options
from ..functions.tapers import checked
from ..operators.prepare import as_number
from ..plans.detect import RESULT
from .online import Online, Series

#: The store that this kind of state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "origin long, reached long, start long, last struct<pos: long, value: double>, signal array<double>, observed array<boolean>, filled array<boolean>, pending array<struct<t: long, order: string, value: double>>, history array<double>, next_window long"
OUT = "window_id long, start_us long, end_us long, grid_start long, grid_stop long, expected_samples int, observed_samples int, interpolated_samples int, valid_ratio double, longest_missing_run int, accepted boolean, rejection_reason string, energy double, baseline double, mad double, robust_scale double, score double, suspicious boolean"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Detector(StatefulProcessor):
    """Feeds the observations of a series to its state, and settles what the watermark has passed.

    A timer at the last pending time wakes a series that gets no more rows.
    """

    def __init__(self, online: Online, keys: list[str]) -> None:
        self.online, self.keys = online, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", STATE)

    def _settled(self, key: tuple, rows: Iterable[Row], watermark: int) -> Iterator[Row]:
        known = self.state.get() if self.state.exists() else None
        series = Series() if known is None else Series(known[0], known[1], known[2], tuple(known[3]) if known[3] is not None else None, *(list(x) for x in known[4:7]), [tuple(p) for p in known[7]], list(known[8]), known[9])
        for row in rows:
            self.online.add(series, row["_t"], row["_order"], row["_signal"])
        for window in self.online.settle(series, watermark * 1000):
            yield Row(**dict(zip(self.keys, key, strict=True)), **{c: window[c] for c in COLUMNS})
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if series.pending:
            self.handle.registerTimer(-(-max(p[0] for p in series.pending) // 1000))
        self.state.update(astuple(series))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._settled(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._settled(key, (), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def detect_stream(
    rows: DataFrame,
    *,
    time_col: str = "time",
    value_col: str = "value",
    series_cols: Sequence[str],
    quality_col: str | None = None,
    valid_quality_flags: Iterable | None = None,
    order_col: str | None = None,
    sampling_period: timedelta | str,
    delay: str = "0 seconds",
    **options,
) -> DataFrame:
    """The rows of ``detect_energy_anomalies``'s result as a stream in append mode, a row for each window once it is complete.

    A window is complete when the watermark (the latest time seen less ``delay``) has passed it, and, where its last samples are
    missing, when the gap is closed by an observation or longer than what is filled. A row whose time the watermark has
    passed is late and dropped. The grid of a series begins at the first time that is settled; each row after it must lie on
    the grid. What a series keeps is a window's samples, what is pending, and one history. Set ``STORE`` in the session.
    """
    o = Options(**options)
    axis = Axis.of(rows.schema[time_col].dataType)
    if axis.kind not in ("ntz", "instant"):
        raise TypeError("a stream needs timestamps")
    if not series_cols:
        raise ValueError("a stream tells series apart by series_cols: name one column at least")
    if quality_col is not None and valid_quality_flags is None:
        raise ValueError("a quality_col says nothing without valid_quality_flags")
    online = Online(o, axis.period(sampling_period), checked(o.window_name, o.window_size))
    value = as_number(value_col, rows.schema[value_col].dataType)
    if quality_col is not None:
        value = F.when(F.col(quality_col).isin(list(valid_quality_flags)), value)
    order = F.lpad(F.col(order_col).cast("string"), 20, "0") if order_col else F.lit("")
    slim = rows.select(*series_cols, axis.encode(time_col).alias("_t"), F.coalesce(order, F.lit("")).alias("_order"), value.alias("_signal")).filter("_t IS NOT NULL")
    slim = slim.withColumn("_at", F.timestamp_micros("_t")).withWatermark("_at", delay)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in series_cols) + ", " + OUT
    found = slim.groupBy(*series_cols).transformWithState(statefulProcessor=Detector(online, list(series_cols)), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    found = found.withColumn("start_time", axis.decode(F.col("start_us"))).withColumn("end_time", axis.decode(F.col("end_us")))
    return found.select(*series_cols, *RESULT)
