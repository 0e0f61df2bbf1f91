"""The second stage: groups, periods, and the transform of each."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark import analyze_msst_periods, msst_stft, plot_msst_periods, prepare_analysis_periods
from wavelark.functions import tfr
from wavelark.operators import periods


#: Seven windows of five samples, three apart; the signal is the square of the place.
LENGTH, STEP, COUNT = 5, 3, 7


def inputs(spark, odd=(2, 3), length=LENGTH):
    at = [(i, STEP * i) for i in range(COUNT)]
    result = spark.createDataFrame([(i, a, a + length, True, i in odd) for i, a in at], "window_id long, grid_start long, grid_stop long, accepted boolean, suspicious boolean")
    rows = [(i, list(range(a, a + LENGTH)), [float(x * x) for x in range(a, a + LENGTH)], [x % 4 != 1 for x in range(a, a + LENGTH)], [x % 4 == 1 for x in range(a, a + LENGTH)]) for i, a in at]
    return result, spark.createDataFrame(rows, "window_id long, time array<long>, signal array<double>, observed_mask array<boolean>, interpolated_mask array<boolean>")


def test_group_and_extension(spark):
    meta, kept = prepare_analysis_periods(*inputs(spark), period_size=11)
    (m,), (k,) = meta.collect(), kept.collect()
    assert m["source_window_ids"] == [2, 3] and m["anomaly_samples"] == 8
    assert (m["period_grid_start"], m["period_grid_stop"], m["start_time"], m["end_time"]) == (6, 17, 6, 16)
    assert k["signal"] == [float(x * x) for x in range(6, 17)] and k["anomaly_mask"] == [True] * 8 + [False] * 3
    assert k["interpolated_mask"] == [x % 4 == 1 for x in range(6, 17)] == [not x for x in k["observed_mask"]]


def test_rejected_periods(spark):
    reason = lambda odd, size: prepare_analysis_periods(*inputs(spark, odd), period_size=size)[0].first()["rejection_reason"]
    assert reason((2, 3), 7) == "anomaly_group_too_long" and reason((2, 3), 8) is None
    assert reason((5,), 9) == "insufficient_following_valid_data" and reason((5,), 8) is None
    assert prepare_analysis_periods(*inputs(spark, ()), period_size=5)[0].isEmpty()
    with pytest.raises(ValueError):
        prepare_analysis_periods(*inputs(spark), period_size=1)


def test_touching_windows_join_and_others_do_not(spark):
    groups = lambda length: [r["source_window_ids"] for r in periods.suspicious_groups(inputs(spark, (1, 3, 6), length)[0]).orderBy("period_id").collect()]
    assert groups(5) == [[1], [3], [6]] and groups(6) == [[1, 3], [6]] and groups(9) == [[1, 3, 6]]


def test_groups_over_chunks_are_those_of_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(5)
    windows = [(s, i, a, a + n) for s in "ab" for i, (a, n) in enumerate(zip(sorted(rng.integers(0, 600, 90).tolist()), rng.integers(1, 40, 90).tolist(), strict=True))]
    rows = spark.createDataFrame([(*w, True, True) for w in windows], "s string, window_id long, grid_start long, grid_stop long, accepted boolean, suspicious boolean")
    want, numbers = {}, Counter()
    for s, i, start, stop in sorted(windows, key=lambda w: (w[0], w[2], w[1])):
        if numbers[s] and start <= (last := want[s, numbers[s] - 1])[2]:
            last[0].append(i)
            last[2] = max(last[2], stop)
        else:
            want[s, numbers[s]] = [[i], start, stop]
            numbers[s] += 1
    for chunk in (1, 16, 65_536):
        monkeypatch.setattr(periods, "CHUNK", chunk)
        got = periods.suspicious_groups(rows, ["s"]).collect()
        assert len(got) == len(want)
        assert {(r["s"], r["period_id"]): [r["source_window_ids"], r["anomaly_grid_start"], r["anomaly_grid_stop"]] for r in got} == want


def test_inconsistent_input(spark):
    result, windows = inputs(spark)
    with pytest.raises(ValueError, match="missing columns"):
        prepare_analysis_periods(result.drop("accepted"), windows, period_size=11)
    with pytest.raises(ValueError, match="cannot be rejected"):
        prepare_analysis_periods(result.withColumn("accepted", F.col("window_id") != 2), windows, period_size=11)
    with pytest.raises(ValueError, match="unknown window id"):
        prepare_analysis_periods(result, windows.withColumn("window_id", F.col("window_id") + 3), period_size=8)
    changed = windows.withColumn("signal", F.when(F.col("window_id") == 2, F.transform("signal", lambda x: x + 1)).otherwise(F.col("signal")))
    with pytest.raises(ValueError, match="inconsistent"):
        prepare_analysis_periods(result, changed, period_size=8)


def stub(signal, fs, rounds, *, return_map, **options):
    assert abs(np.mean(signal)) < 1e-9 and (fs, rounds, options) == (5.0, 2, {"hop_length": 3, "gamma": 0.5})
    some = np.arange(8).reshape(2, 4).astype(np.complex128)
    return -3 * some, 1j * some, np.array([0, 2.5]), np.ones((2, 4), np.int32)


def test_analysis_wiring(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    kept = prepare_analysis_periods(*inputs(spark), period_size=11)[1]
    found = analyze_msst_periods(kept, sampling_frequency=5.0, iteration_count=2, hop_length=3, gamma=0.5, kernel=stub)
    rows = found.collect()
    assert len(rows) == 8 and sorted({r["spectral_time"] for r in rows}) == pytest.approx([0.0, 0.6, 1.2, 1.8])
    assert sorted((r["freq_idx"], r["time_idx"], r["stft_im"], r["msst_re"], r["frequency"], r["target_idx"]) for r in rows) == [(f, t, 4.0 * f + t, -3 * (4.0 * f + t), 2.5 * f, 1) for f in range(2) for t in range(4)]
    traces = plot_msst_periods(kept, found).collect()
    assert Counter(r["trace"] for r in traces) == {"processed signal": 11, "anomaly extent": 8, "stft magnitude": 8, "msst magnitude": 8}
    assert {(r["plot_row"], r["title"]) for r in traces} == {(1, f"Period 0 — {x}") for x in ("signal", "STFT", "MSST")} and {r["figure_title"] for r in traces} == {"Fixed-period spectral analysis (1 periods)"}
    assert sorted(r["time"] for r in traces if r["trace"] == "anomaly extent") == list(range(6, 14)) and max(r["z"] for r in traces if r["panel"] == "msst") == 21.0
    with pytest.raises(ValueError, match="max_periods"):
        plot_msst_periods(kept, found, max_periods=0)
    with pytest.raises(ValueError, match="no MSST"):
        plot_msst_periods(kept, found.filter("false"))


@pytest.mark.parametrize("hop", [1, 4])
def test_a_tone_is_found_at_its_frequency(hop):
    x = np.cos(2 * np.pi * 20 * np.arange(400) / 100)
    squeezed, spectrum, f, target = msst_stft(x, 100.0, 3, n_fft=128, window_length=64, window="hann", hop_length=hop, dtype="float64", return_map=True)
    assert spectrum.shape == (65, (400 - 1) // hop + 1) == target.shape
    middle = spectrum.shape[1] // 2
    assert abs(f[np.argmax(np.abs(squeezed[:, middle]))] - 20) <= f[1] / 2 + 1e-9
    assert np.abs(squeezed[:, middle]).max() > np.abs(spectrum[:, middle]).max() * f[1] * 0.99  # energy is gathered, not lost


def test_squeezing_keeps_the_mass_of_each_column():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=200)
    squeezed, spectrum, f, target = msst_stft(x, 10.0, 2, n_fft=32, dtype="float64", return_map=True)
    kept = np.where(target >= 0, spectrum, 0)
    assert squeezed.sum(axis=0) == pytest.approx(kept.sum(axis=0) * f[1])


def test_maps():
    base = np.array([[1, 0], [2, -1], [2, 1]], np.int32)
    assert tfr.compose(base, 1).tolist() == base.tolist()
    assert tfr.compose(base, 2).tolist() == [[2, 0], [2, -1], [2, -1]]
    assert tfr.to_bins(np.array([[0.5, 1.5, 2.5, np.inf, 99, -3]]), 0.0, 1.0, 5).tolist() == [[0, 2, 2, -1, 4, 0]]


def test_kernel_checks():
    ok = np.sin(np.arange(64.0))
    for bad in (np.zeros((2, 2)), np.array([1.0]), np.array([1.0, np.nan])):
        with pytest.raises(ValueError):
            msst_stft(bad, 1.0)
    for more in ({"sampling_frequency": 0.0}, {"iteration_count": 0}, {"hop_length": 0}, {"gamma": -1.0}, {"padtype": "none"}):
        with pytest.raises(ValueError):
            msst_stft(ok, **{"sampling_frequency": 1.0} | more)
    assert msst_stft(ok, 1.0, n_fft=32)[1].dtype == np.complex64
    with pytest.raises(ValueError):
        analyze_msst_periods(None, sampling_frequency=1.0, return_map=True)
