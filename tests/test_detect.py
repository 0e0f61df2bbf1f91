"""The first stage: scenarios with known outcomes, and properties that hold for any layout of the rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark import detect_energy_anomalies, plot_suspicious_windows, plot_window
from wavelark.functions.checks import Options
from wavelark.functions.tapers import taper
from wavelark.operators import gaps, score
from wavelark.operators import windows as windows_of
from wavelark.plans.figures import significant
from wavelark.sources.series import ringing

P = [0.0, 2.0, 0.5, -2.0] * 3
SIZE = len(P)
BASE = {"sampling_period": "1 s", "window_size": SIZE, "min_valid_ratio": 0.6, "max_interpolation_gap": 3, "history_size": 5, "min_history": 3, "k": 4.0, "order_col": "ord"}
START = datetime(2025, 3, 1, 6)


def rows_of(values, skip=(), bad=(), start=START, step=timedelta(seconds=1)):
    return [(start + i * step, v, "bad" if i in bad else "good", i) for i, v in enumerate(values) if i not in skip]


def frame(spark, rows):
    return spark.createDataFrame(rows, "time timestamp_ntz, value double, quality string, ord long")


def run(spark, values, **options):
    more = {k: options.pop(k) for k in ("skip", "bad") if k in options}
    result, windows = detect_energy_anomalies(frame(spark, rows_of(values, **more)), **BASE | options)
    return result.orderBy("window_id").collect(), {w["window_id"]: w for w in windows.collect()}


def energy_of(values):
    """The energy of one window under the Hann taper, in plain NumPy."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIZE) / (SIZE - 1))
    return (((np.array(values) - np.mean(values)) * w) ** 2).sum() / (w**2).sum()


def scaled(*factors):
    return [f * p for f in factors for p in P]


def test_whole_windows_only(spark):
    values = np.sqrt(np.arange(41.0)).tolist()
    result, windows = run(spark, values, min_valid_ratio=1.0)
    assert [r["window_id"] for r in result] == [0, 1, 2] and all(r["accepted"] and r["observed_samples"] == SIZE for r in result)
    assert result[1]["grid_start"] == 12 and result[1]["end_time"] == START + timedelta(seconds=23) and set(windows) == {0, 1, 2}
    assert [r["energy"] for r in result] == pytest.approx([energy_of(values[i : i + SIZE]) for i in (0, 12, 24)])


def test_first_duplicate_stands_even_if_invalid(spark):
    rows = [*rows_of(P), (START + timedelta(seconds=7), -50.0, "good", 70)]
    assert detect_energy_anomalies(frame(spark, rows), **BASE)[1].first()["signal"][7] == P[7]
    rows[5] = (rows[5][0], None, "good", 5)
    rows.append((rows[5][0], 9.0, "good", 71))
    assert detect_energy_anomalies(frame(spark, rows), **BASE)[0].first()["observed_samples"] == SIZE - 1


@pytest.mark.parametrize("how", ["lost", "flagged", "no row"])
def test_two_samples_that_are_missing(spark, how):
    values, gone = [3.0 * i for i in range(SIZE)], {5, 6}
    more = {"skip": gone} if how == "no row" else {}
    if how == "flagged":
        more = {"bad": gone, "quality_col": "quality", "valid_quality_flags": {"good"}}
    if how == "lost":
        values = [float("nan") if i in gone else v for i, v in enumerate(values)]
    (r,), windows = run(spark, values, **more)
    assert (r["observed_samples"], r["interpolated_samples"], r["valid_ratio"]) == (10, 2, 10 / 12)
    assert windows[0]["signal"][5:7] == [15.0, 18.0] and windows[0]["interpolated_mask"] == [i in gone for i in range(SIZE)] == [not x for x in windows[0]["observed_mask"]]


def test_gaps_that_are_short_long_or_split(spark):
    values = [None if i in {2, 3, 4, *range(15, 19), *range(34, 38)} else 0.5 * i for i in range(60)]
    result, windows = run(spark, values)
    told = [(r["observed_samples"], r["interpolated_samples"], r["longest_missing_run"], r["rejection_reason"]) for r in result]
    assert told == [(9, 3, 3, None), (8, 0, 4, "gap_too_long;unfilled_missing_values"), (10, 0, 2, "unfilled_missing_values"), (10, 0, 2, "unfilled_missing_values"), (12, 0, 0, None)]
    assert result[0]["energy"] == pytest.approx(energy_of([0.5 * i for i in range(SIZE)])) and result[1]["energy"] is None and set(windows) == {0, 4}


def test_a_trend_is_no_energy_and_slow_growth_is_normal(spark):
    result, _ = run(spark, [p - 0.7 * (i // SIZE) for i, p in enumerate(scaled(*[1] * 9))], k=25.0)
    assert np.ptp([r["energy"] for r in result]) < 1e-12 and not any(r["suspicious"] for r in result)
    result, _ = run(spark, scaled(*[1.02**i for i in range(15)]), k=12.0)
    base = [r["baseline"] for r in result if r["baseline"] is not None]
    assert len(base) == 12 and not any(r["suspicious"] for r in result) and base == sorted(set(base))


def test_an_anomaly_stays_out_of_the_history(spark):
    values = scaled(1, 1.1, 0.9, 1, 5, 1, 1)
    result, _ = run(spark, values)
    assert [r["window_id"] for r in result if r["suspicious"]] == [4] and result[2]["score"] is None
    kept = [r["energy"] for r in result[:4]]
    assert result[5]["baseline"] == pytest.approx(np.median(kept)) and result[6]["baseline"] == pytest.approx(np.median([*kept, result[5]["energy"]]))
    every, _ = run(spark, values, history_policy="all")
    assert every[5]["baseline"] == pytest.approx(np.median([r["energy"] for r in result[:5]]))


def test_no_deviation_still_gives_a_finite_score(spark):
    result, _ = run(spark, scaled(1, 1, 1, 1, 1.02), k=0.0)
    assert result[3]["mad"] == result[4]["mad"] == 0 and np.isfinite(result[4]["score"]) and result[4]["score"] > 0 and result[4]["suspicious"]


def test_all_rejected(spark):
    result, windows = run(spark, [None if i % 3 else float(i) for i in range(36)], max_interpolation_gap=1, min_valid_samples=5)
    assert not windows and len(result) == 3 and all(r["rejection_reason"] == "insufficient_valid_ratio;insufficient_valid_samples;gap_too_long;unfilled_missing_values" for r in result)


def test_a_long_series_streams_through_one_history(spark):
    rnd = np.random.default_rng(8)
    energies = np.where(rnd.random(200) < 0.1, 9.0, 1.0) + rnd.random(200)
    rows = spark.createDataFrame([(s, i, float(e)) for s in (None, "b") for i, e in enumerate(energies)], "s string, window_id long, energy double")
    o = Options(history_size=6, min_history=3, k=5.0)
    history = score.History(o)
    want = [history.judge(float(e)) for e in energies]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for keys, part in ((["s"], rows.filter("s = 'b'")), ([], rows.filter("s = 'b'"))):
            got = score.against_regular(part, keys, o).orderBy("window_id").collect()
            assert [r["score"] for r in got] == [None if x is None else float(x[3]) for x in want]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(x is not None and abs(x[3]) > 5 for x in want) > 5


def test_blocks_of_windows_give_the_same_windows(spark, monkeypatch):
    values = np.cos(np.arange(150) * 0.9).tolist()
    want = [tuple(r) for r in run(spark, values, overlap=9)[0]]
    monkeypatch.setattr(windows_of, "BLOCK", 13)
    assert len(want) == 47 and [tuple(r) for r in run(spark, values, overlap=9)[0]] == want
    assert [tuple(r) for r in run(spark, values, overlap=0)[0]][1][3] == 12


def test_other_axes_give_the_same_energies(spark):
    values = np.cos(np.arange(32) * 1.3).tolist()
    want = [r["energy"] for r in run(spark, values)[0]]
    plain = frame(spark, rows_of(values))
    for axis, period in ((F.col("time").cast("timestamp"), "1 s"), (F.col("time") - F.lit(START), "1 second"), (F.col("ord") * 0.5, 0.5)):
        result, _ = detect_energy_anomalies(plain.withColumn("time", axis), **BASE | {"sampling_period": period})
        assert [r["energy"] for r in result.orderBy("window_id").collect()] == want
    result, _ = detect_energy_anomalies(plain, **BASE | {"sampling_period": None})
    assert [r["energy"] for r in result.orderBy("window_id").collect()] == want


def test_errors(spark):
    plain = frame(spark, rows_of(P))
    go = lambda data=plain, **o: detect_energy_anomalies(data, **BASE | o)
    with pytest.raises(ValueError, match="overlap"):
        go(overlap=SIZE)
    with pytest.raises(ValueError, match="history_policy"):
        go(history_policy="some")
    with pytest.raises(KeyError):
        go(value_col="none")
    with pytest.raises(TypeError):
        go(plain.withColumn("time", F.lit("x")))
    with pytest.raises(ValueError, match="valid_quality_flags"):
        go(quality_col="quality")
    with pytest.raises(ValueError, match="not exactly aligned"):
        go(frame(spark, [(START, 1.0, "good", 0), (START + timedelta(seconds=1.1), 1.0, "good", 1)]))
    with pytest.raises(ValueError, match="two distinct"):
        go(frame(spark, rows_of([1.0])), sampling_period=None)
    with pytest.raises(ValueError, match="no rows"):
        go(frame(spark, []))
    with pytest.raises(ValueError, match="unit"):
        go(sampling_period=5)
    with pytest.raises(ValueError, match="non-zero energy"):
        go(window_name="hann", window_size=2, overlap=0)


def test_text_values_and_infinity(spark):
    plain = frame(spark, rows_of(P)).withColumn("value", F.when(F.col("ord") == 2, "1.0d").when(F.col("ord") == 3, "abc").otherwise(F.col("value").cast("string")))
    result, _ = detect_energy_anomalies(plain, **BASE)
    assert result.first()["observed_samples"] == SIZE - 2
    values = P * 2 + [float("inf"), *P[1:]] + P * 4
    result, _ = run(spark, values)
    assert result[2]["accepted"] and np.isnan(result[2]["energy"]) and not result[2]["suspicious"]
    assert np.isnan(result[3]["score"]) and not result[3]["suspicious"]


def test_too_short_a_series_keeps_the_schema(spark):
    result, windows = detect_energy_anomalies(frame(spark, rows_of([1.0, 2.0])), **BASE)
    assert result.columns[0] == "window_id" and "score" in result.columns and result.isEmpty() and windows.isEmpty()


def test_layout_and_zone_do_not_matter(spark):
    data = ringing(spark)
    options = {"quality_col": "quality", "valid_quality_flags": ["good"], "order_col": "ord", "sampling_period": "1 s", "window_size": 200, "overlap": 100, "history_size": 10, "min_history": 5, "k": 6.0}
    want = detect_energy_anomalies(data, **options)[0].orderBy("window_id").collect()
    struck = [r["window_id"] for r in want if r["suspicious"]]
    assert len(want) == 59 and struck[:2] == [23, 24] and all(22 < i < 30 for i in struck)
    lost = lambda r: sum(r["grid_start"] <= i < r["grid_stop"] for i in [31, *range(996, 6000, 997), *range(1008, 6000, 1009)])
    assert all(r["observed_samples"] == 200 - lost(r) for r in want) and all(r["accepted"] for r in want)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert detect_energy_anomalies(data.repartition(5), **options)[0].orderBy("window_id").collect() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_many_series_are_each_their_own(spark):
    a, b = rows_of(P * 4), rows_of([3 * p for p in P] * 3, start=START + timedelta(hours=1))
    both = frame(spark, a).withColumn("s", F.lit("a")).union(frame(spark, b).withColumn("s", F.lit("b")))
    result = detect_energy_anomalies(both, series_cols=["s"], **BASE)[0].orderBy("s", "window_id").collect()
    assert [(r["s"], r["window_id"]) for r in result] == [("a", i) for i in range(4)] + [("b", i) for i in range(3)]
    assert result[-1]["energy"] == pytest.approx(9 * result[0]["energy"])


def test_chunks_of_a_long_series_share_their_edges(spark, monkeypatch):
    monkeypatch.setattr(gaps, "CHUNK", 5)
    values = [None if i in (4, 5, 9, 10, 14) else float(i * i) for i in range(20)]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "s string, pos long, signal double")
    got = [r["filled"] for r in gaps.interpolate(rows, ["s"], 2).orderBy("pos").collect()]
    known = [i for i, v in enumerate(values) if v is not None]
    assert got == pytest.approx(np.interp(range(20), known, [values[i] for i in known]).tolist())


def test_runs_of_missing_samples_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(gaps, "CHUNK", 4)
    gone = {0, 3, 4, *range(6, 18), 19, 22, 23}
    rows = spark.createDataFrame([("a", i, None if i in gone else 1.0) for i in range(24)], "s string, pos long, signal double")
    assert sorted((r["run_start"], r["run_stop"]) for r in gaps.missing_runs(rows, ["s"]).collect()) == [(0, 1), (3, 5), (6, 18), (19, 20), (22, 24)]


def test_plots_as_rows(spark):
    values = scaled(1, 1.1, 0.9, 1, 6, 1, 7)
    result, windows = detect_energy_anomalies(frame(spark, rows_of(values)), **BASE)
    rows = plot_suspicious_windows(result, windows).collect()
    assert {(r["window_id"], r["plot_row"]) for r in rows} == {(4, 1), (6, 2)} and {r["trace"] for r in rows} == {"regularized signal", "observed", "centered"}
    scores = {r["window_id"]: r["score"] for r in result.collect()}
    assert {r["title"] for r in rows} == {f"Suspicious window {i} — score={scores[i]:.3g}" for i in (4, 6)} and {r["figure_title"] for r in rows} == {"Energy anomalies (2 windows)"}
    one = plot_suspicious_windows(result, windows, max_windows=1).collect()
    assert {r["window_id"] for r in one} == {4} and one[0]["figure_title"] == "Energy anomalies (1 windows)"
    assert plot_window(4, result, windows, show_centered=False).first()["title"] == "Window 4 (suspicious)" and plot_window(0, result, windows).first()["title"] == "Window 0 (normal)"
    with pytest.raises(KeyError):
        plot_window(77, result, windows)
    with pytest.raises(ValueError, match="max_windows"):
        plot_suspicious_windows(result, windows, max_windows=0)
    with pytest.raises(ValueError, match="no suspicious"):
        plot_suspicious_windows(result.filter("false"), windows)
    with pytest.raises(ValueError, match="missing WindowData"):
        plot_suspicious_windows(result, windows.filter("false"))


def test_numbers_with_three_digits(spark):
    given = [6.5, 668.4651, 0.0, 1351.2, 12.3456, 99.99, 1.2345e-05, 0.00012345, -45.678, 1e17, 999.6, 3.0, -2.5e-7, 123456.0]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double").select("i", significant(F.col("x")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [f"{x:.3g}" for x in given]


def test_tapers():
    n = np.arange(9)
    assert taper("hann", 9) == pytest.approx(0.5 - 0.5 * np.cos(2 * np.pi * n / 8))
    assert taper("boxcar", 4).tolist() == [1.0] * 4
    for name in ("hamming", "blackman", "nuttall", "flattop", "bartlett", "triang", "cosine", "parzen", "bohman", ("gaussian", 2.0), ("kaiser", 8.0), ("tukey", 0.3)):
        w = taper(name, 16)
        assert w == pytest.approx(w[::-1]) and w.max() <= 1 + 1e-9
    with pytest.raises(ValueError):
        taper("none", 8)
