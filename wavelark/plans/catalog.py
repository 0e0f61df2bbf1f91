"""Named queries over the tables at hand, one for each operator of the engine, and the stages they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.checks import Options
from ..functions.tapers import checked
from ..operators import gaps, grid, periods, prepare, score, windows
from ..sources import series
from ..sources.workspace import Workspace
from ..streaming import detect as streaming
from . import analyze, detect, figures

KEYS = ["event_type"]
#: Options of the queries over hourly event values.
HOURLY = {"window_size": 24, "overlap": 12, "min_valid_ratio": 0.6, "max_interpolation_gap": 3, "history_size": 12, "min_history": 5, "k": 4.0}
#: Options of the queries over daily totals, and over vectors taken as series.
DAILY = {"window_size": 64, "overlap": 32, "min_valid_ratio": 0.9, "history_size": 20, "min_history": 5, "k": 4.0}
VECTORS = {"window_size": 16, "min_valid_ratio": 1.0, "max_interpolation_gap": 0, "history_size": 3, "min_history": 2, "k": 3.0, "history_policy": "all"}
#: Options of windows that overlap but for one sample, against a history longer than most.
DENSE = {**HOURLY, "overlap": 23, "history_size": 300, "min_history": 100, "history_policy": "all"}
PERIOD_SIZE = 48
#: The transform of the queries: a day has 24 samples.
RATE, SPECTRUM = 24.0, {"window": "hann", "n_fft": 16, "hop_length": 4, "dtype": "float64", "gamma": 1e-8}
ROUNDS = 3
TAPERS = ("boxcar", "hamming", "blackman", "bartlett", "cosine")


def tidy(value: str | Column, digits: int = 6) -> Column:
    """A double with some digits, and no negative zero. The nudge puts halves on one side whatever the order of sums."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-9, digits) + F.lit(0.0)


def figured(result: DataFrame) -> DataFrame:
    """The result with its figures to a number of digits that does not depend on the order of sums."""
    for name, digits in (("energy", 6), ("baseline", 6), ("mad", 6), ("robust_scale", 6), ("score", 4), ("valid_ratio", 6)):
        result = result.withColumn(name, tidy(name, digits))
    return result


@dataclass
class Staged:
    """The steps of the first stage over hourly event values, each built on the one before."""

    spark: SparkSession
    sf_dir: str
    options: Options = field(default_factory=lambda: Options(**HOURLY))

    def hourly(self) -> DataFrame:
        return series.hourly_values(self.spark.read.parquet(f"{self.sf_dir}/events.parquet"))

    def prepared(self) -> tuple[DataFrame, Axis]:
        return prepare.prepare(self.hourly(), "time", "value", KEYS, "quality", ["good"])

    def regular(self) -> tuple[DataFrame, DataFrame, Axis]:
        rows, axis = self.prepared()
        return (*grid.regularize(rows, KEYS, axis, axis.period("1 hour")), axis)

    def filled(self) -> tuple[DataFrame, DataFrame, Axis]:
        rows, grids, axis = self.regular()
        return gaps.interpolate(rows, KEYS, self.options.max_interpolation_gap), grids, axis

    def members(self) -> tuple[DataFrame, Axis]:
        rows, grids, axis = self.filled()
        return windows.membership(rows, grids, KEYS, self.options), axis

    def measured(self) -> DataFrame:
        rows, _, axis = self.filled()
        return windows.measured(rows, KEYS, axis, self.options, checked(self.options.window_name, self.options.window_size))

    def detected(self) -> tuple[DataFrame, DataFrame]:
        result, samples = detect.detect_energy_anomalies(self.hourly(), series_cols=KEYS, quality_col="quality", valid_quality_flags=["good"], sampling_period="1 hour", **HOURLY)
        return result.persist(), samples.persist()  # later steps read each several times

    def periods(self) -> tuple[DataFrame, DataFrame]:
        return periods.prepare_analysis_periods(*self.detected(), period_size=PERIOD_SIZE, series_cols=KEYS)

    def analysed(self) -> tuple[DataFrame, DataFrame]:
        kept = self.periods()[1].persist()
        return kept, analyze.analyze_msst_periods(kept, sampling_frequency=RATE, iteration_count=ROUNDS, series_cols=KEYS, **SPECTRUM)


def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event, by id, of each kind and hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), "event_id", "value")
    return prepare.keep_first(events, ["event_type", "time"], ["event_id"])


def quality_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, axis = Staged(spark, sf_dir).prepared()
    return rows.select("event_type", axis.decode(F.col("t")).alias("time"), "signal", "observed")


def period_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microseconds between neighbouring events of a kind, as a median."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows, axis = prepare.prepare(events, "ts", "value", KEYS, order_col="event_id")
    return grid.estimate_periods(rows, KEYS, axis)


def regular_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, axis = Staged(spark, sf_dir).regular()
    return rows.select("event_type", "pos", axis.decode(F.col("t")).alias("time"), "signal", "observed")


def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.missing_runs(Staged(spark, sf_dir).regular()[0], KEYS)


def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Staged(spark, sf_dir).filled()[0].select("event_type", "pos", tidy("filled").alias("filled"), "observed", "interpolated")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Staged(spark, sf_dir).members()[0].select("event_type", "window_id", "pos", "observed", "interpolated")


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Staged(spark, sf_dir).measured()
    return rows.select("event_type", "window_id", "observed_samples", "interpolated_samples", "longest_missing_run", tidy("valid_ratio").alias("valid_ratio"), "accepted", "rejection_reason")


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Staged(spark, sf_dir).measured().select("event_type", "window_id", tidy("energy").alias("energy"))


def scored(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Staged(spark, sf_dir).measured().filter("accepted").select("event_type", "window_id", "energy")
        out = score.score(rows, KEYS, Options(**HOURLY, history_policy=policy))
        return out.select("event_type", "window_id", *[tidy(c, 4 if c == "score" else 6).alias(c) for c in ("energy", *score.SCORES)], "suspicious")

    return query


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole first stage with its default policy: one row per window of every kind of event."""
    return figured(Staged(spark, sf_dir).detected()[0])


def window_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of accepted windows, one row each."""
    rows = Staged(spark, sf_dir).detected()[1]
    rows = rows.select("event_type", "window_id", F.posexplode(F.arrays_zip("time", "signal", "centered", "windowed", "observed_mask", "interpolated_mask")).alias("sample", "s"))
    return rows.select("event_type", "window_id", "sample", F.col("s.time").alias("time"), *[tidy(F.col(f"s.{c}")).alias(c) for c in ("signal", "centered", "windowed")], F.col("s.observed_mask").alias("observed"), F.col("s.interpolated_mask").alias("interpolated"))


def top_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five suspicious windows of each kind of event: a report."""
    rows = figures.top_suspicious(Staged(spark, sf_dir).detected()[0], 5, KEYS)
    return rows.select("event_type", "window_id", "start_time", "end_time", tidy("energy").alias("energy"), tidy("score", 4).alias("score"))


def suspicious_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = figures.plot_suspicious_windows(*Staged(spark, sf_dir).detected(), series_cols=KEYS, required=False)
    return rows.select("event_type", "window_id", "plot_row", "title", "figure_title", "trace", "x", tidy("y").alias("y"))


def window_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first accepted window, in the order of series and window."""
    result, samples = Staged(spark, sf_dir).detected()
    one = result.filter("accepted").orderBy("event_type", "window_id").select("event_type", "window_id").first()
    if one is None:  # no window to show: no rows
        empty = samples.limit(0).withColumn("plot_row", F.lit(1)).withColumn("title", F.lit(""))
        return figures._window_traces(empty, ["window_id", "plot_row", "title"], True).select("window_id", "plot_row", "title", "trace", "x", tidy("y").alias("y"))
    rows = figures.plot_window(one["window_id"], result, samples, series={"event_type": one["event_type"]})
    return rows.select("window_id", "plot_row", "title", "trace", "x", tidy("y").alias("y"))


def tapered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies of all windows under further tapers, told in words of their formulas."""
    rows, _, axis = Staged(spark, sf_dir).filled()
    o = Options(**HOURLY)
    parts = [windows.measured(rows, KEYS, axis, o, checked(name, o.window_size)).select("event_type", "window_id", F.lit(name).alias("taper"), tidy("energy").alias("energy")) for name in TAPERS]
    return reduce(DataFrame.unionByName, parts)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periods.suspicious_groups(Staged(spark, sf_dir).detected()[0], KEYS)
    return rows.withColumn("source_window_ids", F.array_join(F.col("source_window_ids").cast("array<string>"), ","))


def sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periods.sample_index(*Staged(spark, sf_dir).detected(), KEYS)
    return rows.withColumn("signal", tidy("signal"))


def period_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Staged(spark, sf_dir).periods()[0]
    return rows.withColumn("source_window_ids", F.array_join(F.col("source_window_ids").cast("array<string>"), ","))


def period_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Staged(spark, sf_dir).periods()[1]
    rows = rows.select("event_type", "period_id", F.posexplode(F.arrays_zip("time", "signal", "observed_mask", "interpolated_mask", "anomaly_mask")).alias("sample", "s"))
    return rows.select("event_type", "period_id", "sample", F.col("s.time").alias("time"), tidy(F.col("s.signal")).alias("signal"), F.col("s.observed_mask").alias("observed"), F.col("s.interpolated_mask").alias("interpolated"), F.col("s.anomaly_mask").alias("anomaly"))


SPOT = ["event_type", "period_id", "freq_idx", "time_idx"]


def stft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Staged(spark, sf_dir).analysed()[1]
    return rows.select(*SPOT, *[tidy(c).alias(c) for c in ("frequency", "spectral_time", "stft_re", "stft_im")])


def frequency_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Staged(spark, sf_dir).analysed()[1].select(*SPOT, "target_idx")


def msst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Staged(spark, sf_dir).analysed()[1]
    return rows.select(*SPOT, tidy("msst_re").alias("msst_re"), tidy("msst_im").alias("msst_im"), tidy(analyze.magnitude("msst")).alias("magnitude"))


def msst_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = figures.plot_msst_periods(*Staged(spark, sf_dir).analysed(), series_cols=KEYS, required=False)
    return rows.select("event_type", "period_id", "plot_row", "title", "figure_title", "panel", "trace", "time", tidy("x").alias("x"), tidy("y").alias("y"), tidy("z").alias("z"))


def dense_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage with a window at every hour, each against the 300 before it."""
    staged = Staged(spark, sf_dir)
    return figured(detect.detect_energy_anomalies(staged.hourly(), series_cols=KEYS, quality_col="quality", valid_quality_flags=["good"], sampling_period="1 hour", **DENSE)[0])


def whole_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform of the whole signal of each kind of event, but for frames with missing samples."""
    rows = Staged(spark, sf_dir).filled()[0].select("event_type", "pos", F.col("filled").alias("signal"))
    out = analyze.analyze_signal(rows, sampling_frequency=RATE, iteration_count=ROUNDS, series_cols=KEYS, **SPECTRUM)
    return out.select("event_type", "freq_idx", "time_idx", *[tidy(c).alias(c) for c in ("stft_re", "stft_im", "msst_re", "msst_im")], "target_idx")


def detected_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage as a stream over files of hourly values, run until all of them are read; what it has put out.

    A stream does not know that a series ends. So each gets one more observation, too far away for the gap before it to be
    filled; windows that reach beyond the series' own last hour are left out.
    """
    work = Workspace(spark)
    hourly = Staged(spark, sf_dir).hourly()
    ends = hourly.groupBy(*KEYS).agg(F.max("time").alias("last"))
    beyond = F.expr(f"last + make_dt_interval(0, {HOURLY['max_interpolation_gap'] + 2})")
    closing = ends.select(*KEYS, beyond.alias("time"), F.lit(0.0).alias("value"), F.lit(1).cast("long").alias("n"), F.lit("good").alias("quality"))
    hourly = work.keep(hourly.unionByName(closing), "hours")
    before = spark.conf.get(streaming.STORE[0], None)
    spark.conf.set(*streaming.STORE)
    try:
        rows = spark.readStream.schema(hourly.schema).parquet(hourly.kept_at)
        found = streaming.detect_stream(rows, series_cols=KEYS, quality_col="quality", valid_quality_flags=["good"], sampling_period="1 hour", **HOURLY)
        query = found.writeStream.format("parquet").option("checkpointLocation", f"{work.folder}/state").trigger(availableNow=True).start(f"{work.folder}/result")
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(streaming.STORE[0])
        else:
            spark.conf.set(streaming.STORE[0], before)
    rows = spark.read.schema(found.schema).parquet(f"{work.folder}/result").join(ends, KEYS)
    return figured(rows.filter(F.col("end_time") <= F.col("last")).drop("last"))


def of_days(name: str, make: Callable[[DataFrame], DataFrame], period: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """The first stage over the daily totals of a table; without a period, it is inferred."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result, _ = detect.detect_energy_anomalies(make(spark.read.parquet(f"{sf_dir}/{name}.parquet")), sampling_period=period, **DAILY)
        return relative(result)

    return query


def relative(result: DataFrame) -> DataFrame:
    """Energies of large totals, by their first twelve digits."""
    digits = lambda c: F.format_string("%.11e", F.col(c))
    keep: Sequence[str] = ["window_id", "start_time", "end_time", "observed_samples", "interpolated_samples", "longest_missing_run", "accepted", "rejection_reason"]
    return result.select(*keep, F.when(F.col("energy").isNotNull(), digits("energy")).alias("energy"), tidy("score", 4).alias("score"), "suspicious")


def vector_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a series on a numeric axis of period 0.5."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "value"))
    rows = rows.select("vec_id", (F.col("i") * 0.5).alias("time"), "value")
    result, _ = detect.detect_energy_anomalies(rows, series_cols=["vec_id"], sampling_period=0.5, **VECTORS)
    return result.select("vec_id", "window_id", "start_time", "end_time", "observed_samples", "accepted", tidy("energy").alias("energy"), tidy("baseline").alias("baseline"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "q_dedup_keep_first": keep_first,
        "q_quality_mask": quality_mask,
        "q_period_estimate": period_estimate,
        "q_regular_grid": regular_grid,
        "q_missing_runs": missing_runs,
        "q_interpolate": interpolated,
        "q_window_membership": membership,
        "q_window_acceptance": acceptance,
        "q_window_energy": energy,
        "q_score_all": scored("all"),
        "q_score_exclude": scored("exclude_suspicious"),
        "q_detect": detected,
        "q_window_data": window_data,
        "q_top_suspicious": top_suspicious,
        "q_plot_suspicious": suspicious_plot,
        "q_plot_window": window_plot,
        "q_tapers": tapered,
        "q_suspicious_groups": groups,
        "q_sample_index": sample_index,
        "q_periods": period_table,
        "q_period_samples": period_samples,
        "q_stft": stft,
        "q_freq_map": frequency_map,
        "q_msst": msst,
        "q_plot_msst": msst_plot,
        "q_daily_quantity": of_days("lineitem", series.daily_quantity),
        "q_daily_price": of_days("orders", series.daily_price, "1 day"),
        "q_vector_series": vector_series,
        "q_dense_windows": dense_windows,
        "q_signal_msst": whole_signals,
        "q_detect_stream": detected_stream,
    }
