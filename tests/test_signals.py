"""Windows that overlap densely, transforms of whole signals, further tapers, data sources, and limits of plots."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark import detect_energy_anomalies, msst_stft, plot_suspicious_windows, plot_window
from wavelark.functions import dense, tfr
from wavelark.functions.axis import Axis
from wavelark.functions.checks import Options
from wavelark.functions.tapers import checked, slepian, taper
from wavelark.operators import windows
from wavelark.plans import analyze
from wavelark.plans.figures import significant
from wavelark.sources import datasources
from wavelark.sources.series import ringing


def fold(values, weights):
    """The energy of one window, added up sample by sample."""
    mean = math.fsum(values) / len(values)
    return math.fsum(((v - mean) * w) ** 2 for v, w in zip(values, weights, strict=True)) / math.fsum(w * w for w in weights)


@pytest.mark.parametrize("name", ["hann", "boxcar", "blackman", "flattop", ("general_hamming", 0.6), ("general_cosine", [0.4, 0.35, 0.25])])
def test_energies_of_all_windows_at_once(name):
    rng = np.random.default_rng(2)
    x = 1e6 + np.cumsum(rng.normal(size=3000)) + 40 * np.sin(np.arange(3000) / 9)
    x[1500:1600] = 7.0
    x[2222] = np.nan
    size, starts = 101, np.arange(0, 3000 - 101 + 1, 3)
    got = dense.energies(x, size, starts, dense.cosine_coefficients(name))
    weights = taper(name, size).tolist()
    for s, e in zip(starts.tolist(), got, strict=True):
        if s <= 2222 < s + size:
            assert np.isnan(e)
        else:
            assert e == pytest.approx(fold(x[s : s + size].tolist(), weights), rel=1e-9, abs=1e-7)
    assert dense.cosine_coefficients(("kaiser", 3.0)) is None


def test_a_window_at_each_of_a_million_samples(spark):
    n, size = 1_000_000, 4096
    # A hum whose frequency drifts, and noise that is a hash of the place.
    rows = spark.range(0, n, 1, 8).select(F.col("id").alias("pos"), F.col("id").alias("t"), (F.sin(F.col("id") / 40 + F.col("id") * F.col("id") / 3e9) * 3 + F.pmod(F.hash("id"), F.lit(1000)) / 1000).alias("filled"), (F.col("id") % 9973 > 2).alias("observed"), (F.col("id") % 9973 <= 2).alias("interpolated"))
    o = Options(window_size=size, overlap=size - 1, min_valid_ratio=0.9)
    assert windows.is_dense(o) and not windows.is_dense(Options(window_size=size, overlap=size // 2)) and not windows.is_dense(Options(window_size=size, overlap=size - 1, window_name=("kaiser", 3.0)))
    found = windows.measured_densely(rows, [], Axis("ntz"), o)
    total = found.agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("accepted"), F.max("longest_missing_run").alias("run"), F.sum("observed_samples").alias("observed")).first()
    assert total["n"] == total["accepted"] == n - size + 1 and total["run"] == 3
    picked = found.filter(F.col("window_id") % 99_991 == 5).orderBy("window_id").collect()
    x = np.array([r["filled"] for r in rows.filter(" OR ".join(f"pos BETWEEN {r['grid_start']} AND {r['grid_stop'] - 1}" for r in picked)).orderBy("pos").collect()]).reshape(len(picked), size)
    weights = taper("hann", size).tolist()
    assert [r["energy"] for r in picked] == pytest.approx([fold(v.tolist(), weights) for v in x], rel=1e-9)
    assert [r["observed_samples"] for r in picked] == [sum(i % 9973 > 2 for i in range(r["grid_start"], r["grid_stop"])) for r in picked]


def test_dense_windows_are_the_windows(spark, monkeypatch):
    start = dt.datetime(2025, 1, 1)
    rng = np.random.default_rng(6)
    gone = {i for i in range(700) if rng.random() < 0.1 or 200 < i < 215}
    rows = [(s, start + dt.timedelta(seconds=i), float(np.sin(i / 5) + rng.normal() / 9 + 5 * (400 < i < 420))) for s in "ab" for i in range(700) if i not in gone or s == "b"]
    df = spark.createDataFrame(rows, "s string, time timestamp_ntz, value double")
    more = {"series_cols": ["s"], "sampling_period": "1 s", "window_size": 32, "overlap": 30, "min_valid_ratio": 0.5, "history_size": 10, "min_history": 3}
    monkeypatch.setattr(windows, "BLOCK", 64)
    got = detect_energy_anomalies(df, **more)[0].orderBy("s", "window_id").collect()
    monkeypatch.setattr(windows, "DENSE", 10**9)
    want = detect_energy_anomalies(df, **more)[0].orderBy("s", "window_id").collect()
    assert len(got) == len(want) == 2 * 335 and got[0].asDict().keys() == want[0].asDict().keys() and any(not r["accepted"] for r in want)
    for g, w in zip(got, want, strict=True):
        for c in g.asDict():
            assert g[c] == (pytest.approx(w[c], rel=1e-7, abs=1e-9) if isinstance(w[c], float) else w[c]), c


def test_longest_runs_of_all_windows():
    rng = np.random.default_rng(8)
    for share in (0.0, 0.1, 0.6, 1.0):
        missing = rng.random(300) < share
        starts = np.arange(0, 300 - 40 + 1)
        want = [max((len(x) for x in re.findall("1+", "".join("1" if m else "0" for m in missing[s : s + 40]))), default=0) for s in starts]
        assert dense.longest_runs(missing, 40, starts).tolist() == want


@pytest.mark.parametrize("padtype", ["reflect", "symmetric", "zero", "replicate"])
def test_a_signal_in_chunks_is_the_signal(spark, monkeypatch, padtype):
    monkeypatch.setattr(analyze, "CHUNK_FRAMES", 7)
    rng = np.random.default_rng(1)
    n, more = 403, {"window": "hann", "n_fft": 32, "window_length": 24, "hop_length": 3, "padtype": padtype, "dtype": "float64", "gamma": 1e-6}
    signals = {"a": np.cos(np.arange(n) ** 1.2) + rng.normal(size=n) / 5, "b": rng.normal(size=9)}
    rows = spark.createDataFrame([(s, i, float(x)) for s, v in signals.items() for i, x in enumerate(v)], "s string, pos long, signal double").repartition(6)
    found = analyze.analyze_signal(rows, sampling_frequency=4.0, iteration_count=5, series_cols=["s"], **more).collect()
    for s, v in signals.items():
        if len(v) < 32 and padtype == "symmetric":
            continue
        squeezed, spectrum, frequency, target = msst_stft(v - v.mean(), 4.0, 5, return_map=True, **more)
        got = {(r["freq_idx"], r["time_idx"]): r for r in found if r["s"] == s}
        assert len(got) == spectrum.size
        for (f, t), r in got.items():
            assert (r["frequency"], r["spectral_time"], r["target_idx"]) == (pytest.approx(frequency[f]), t * 3 / 4.0, target[f, t])
            assert complex(r["stft_re"], r["stft_im"]) == pytest.approx(spectrum[f, t], abs=1e-9) and complex(r["msst_re"], r["msst_im"]) == pytest.approx(squeezed[f, t], abs=1e-9)
    holes = analyze.analyze_signal(rows.withColumn("signal", F.when(F.col("pos") != 200, F.col("signal"))), sampling_frequency=4.0, series_cols=["s"], **more)
    times = {r["time_idx"] for r in holes.filter("s = 'a'").select("time_idx").distinct().collect()}
    assert times == {t for t in range((n - 1) // 3 + 1) if not 3 * t - 15 <= 200 <= 3 * t + 16}
    with pytest.raises(ValueError, match="padtype"):
        analyze.analyze_signal(rows, sampling_frequency=4.0, padtype="wrap")


def test_maps_of_very_many_rounds():
    rng = np.random.default_rng(5)
    base = rng.integers(-1, 40, (40, 6)).astype(np.int32)
    step = base.copy()
    for count in range(1, 65):
        assert np.array_equal(tfr.compose(base, count), step)
        step = np.where(step >= 0, np.take_along_axis(base, np.maximum(step, 0), axis=0), -1)
    far = np.vstack([np.arange(1, 1000), np.full(999, 0)]).T  # a walk along a line, and one that stands
    assert tfr.compose(np.vstack([far, [[999, 0]]]).astype(np.int32), 10**6)[:, 0].tolist() == [999] * 1000


def test_tapers_by_their_properties():
    for size in (33, 64):
        w = taper(("chebwin", 55.0), size)
        spectrum = 20 * np.log10(np.abs(np.fft.rfft(w, 1 << 15)) / w.sum() + 1e-15)
        lobes = [spectrum[i] for i in range(1, len(spectrum) - 1) if spectrum[i - 1] < spectrum[i] >= spectrum[i + 1]]
        assert lobes == pytest.approx([-55.0] * len(lobes), abs=0.01) and len(lobes) > 10
        w = taper(("taylor", 5, 35.0), size)
        spectrum = 20 * np.log10(np.abs(np.fft.rfft(w, 1 << 15)) / w.sum() + 1e-15)
        lobes = [spectrum[i] for i in range(1, len(spectrum) - 1) if spectrum[i - 1] < spectrum[i] >= spectrum[i + 1]]
        assert lobes[:4] == pytest.approx([-35.0] * 4, abs=2.5) and max(lobes) <= -34.5
        for name in (("dpss", 3.0), "barthann", "lanczos", ("exponential", None, 4.0), ("general_gaussian", 1.5, 5.0), ("general_hamming", 0.7), ("general_cosine", [0.5, 0.3, 0.2])):
            w = taper(name, size)
            assert w == pytest.approx(w[::-1]) and w.max() <= 1 + 1e-9 and len(checked(name, size)) == size
    assert taper(("general_gaussian", 1.0, 3.0), 20) == pytest.approx(taper(("gaussian", 3.0), 20)) and taper(("general_hamming", 0.54), 20) == pytest.approx(taper("hamming", 20))
    n, w = 200, slepian(200, 3.0)
    kernel = np.sinc(2 * 3.0 / n * (np.arange(n)[:, None] - np.arange(n))) * 2 * 3.0 / n  # its eigenvector: most energy within the band
    held = kernel @ w / w
    assert held == pytest.approx(held[100], rel=1e-6) and 1 - 1e-4 < held[100] < 1
    assert len(slepian(65_536)) == 65_536


def test_synthetic_source_is_the_series(spark):
    datasources.register(spark)
    for options, more in (({}, {}), ({"samples": "1500", "strike": "700", "seed": "11", "partitions": "5"}, {"samples": 1500, "strike": 700, "seed": 11})):
        got = spark.read.format("wavelark_ringing").options(**options).load()
        want = ringing(spark, **more)
        a, b = (sorted(map(tuple, df.select("ord", "time", "value", "quality").collect()), key=lambda r: r[0]) for df in (got, want))
        assert [r[:2] + r[3:] for r in a] == [r[:2] + r[3:] for r in b] and [r[2] is None for r in a] == [r[2] is None for r in b]
        assert [r[2] for r in a if r[2] is not None] == pytest.approx([r[2] for r in b if r[2] is not None], rel=1e-12, abs=1e-12)
    assert spark.read.format("wavelark_ringing").option("partitions", 5).load().rdd.getNumPartitions() == 5


def two_series(spark):
    start = dt.datetime(2025, 1, 1)
    values = [math.sin(2 * math.pi * i / 10) * (9 if i // 10 in (5, 8, 11) else 1 + (i // 10 % 3) / 20) for i in range(140)]
    rows = [(s, start + dt.timedelta(seconds=i), v) for s in ("a<b>", "b") for i, v in enumerate(values)]
    result, samples = detect_energy_anomalies(spark.createDataFrame(rows, "s string, time timestamp_ntz, value double"), series_cols=["s"], sampling_period="1 s", window_size=10, history_size=5, min_history=3)
    return result.withColumn("suspicious", F.col("window_id").isin(5, 8, 11)), samples  # the bursts, and none of the first windows


def test_figures_are_pages(spark, tmp_path):
    result, samples = two_series(spark)
    rows = plot_suspicious_windows(result, samples, series_cols=["s"])
    datasources.write_figures(rows, str(tmp_path / "pages"), ["s"])
    pages = {p.name: p.read_text() for p in (tmp_path / "pages").iterdir()}
    assert set(pages) == {"a%3cb%3e.html", "b.html"}
    assert all(p.count("\nadd(") == rows.filter(F.col("s") == s).count() for p, s in ((pages["b.html"], "b"), (pages["a%3cb%3e.html"], "a<b>")))
    assert "<title>Energy anomalies (3 windows) — a&lt;b&gt;</title>" in pages["a%3cb%3e.html"] and pages["b.html"].rstrip().endswith("</script>")
    failing = rows.withColumn("y", F.when(F.col("s") == "b", F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("y")))
    with pytest.raises(Exception, match="no"):
        datasources.write_figures(failing, str(tmp_path / "none"), ["s"])
    assert not any((tmp_path / "none").rglob("*.html"))
    with pytest.raises(Exception, match="lack"):
        datasources.write_figures(rows.drop("trace").withColumn("trace_", F.lit(1)).withColumn("trace", F.lit("x")).drop("y"), str(tmp_path / "none"), ["s"])


def test_limits_hold_for_each_series(spark):
    result, samples = two_series(spark)
    rows = plot_suspicious_windows(result, samples, series_cols=["s"], max_windows=2).select("s", "window_id", "figure_title").distinct().collect()
    assert sorted((r["s"], r["window_id"]) for r in rows) == [("a<b>", 5), ("a<b>", 8), ("b", 5), ("b", 8)] and {r["figure_title"] for r in rows} == {"Energy anomalies (2 windows)"}
    with pytest.raises(ValueError, match="several series"):
        plot_window(5, result, samples)
    assert {r["s"] for r in plot_window(5, result, samples, series={"s": "b"}).join(result.select("s", "window_id").filter("s = 'b'"), "window_id").collect()} == {"b"}
    with pytest.raises(KeyError):
        plot_window(5, result, samples, series={"s": "c"})
    assert plot_suspicious_windows(result.filter("false"), samples, series_cols=["s"], required=False).count() == 0


def test_scores_without_end(spark):
    rows = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double").select(significant(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["inf", "-inf", "nan", "nan"]


@pytest.mark.parametrize("text", ["1h30min", "00:00:01", "1 days 02:00:00", "90 min", "1.5 h", "2 hours 3 minutes 4.5 seconds", "1 day, 3:04:05.25", "-1 days +02:00:00", "h", "250ms", "1w", "0:30"])
def test_periods_as_texts(text):
    plain = {"1h30min": 5400, "00:00:01": 1, "1 days 02:00:00": 93_600, "90 min": 5400, "1.5 h": 5400, "2 hours 3 minutes 4.5 seconds": 7384.5, "1 day, 3:04:05.25": 97_445.25, "h": 3600, "250ms": 0.25, "1w": 604_800, "0:30": 1800}
    if text.startswith("-"):
        with pytest.raises(ValueError, match="positive"):
            Axis("ntz").period(text)
    else:
        assert Axis("ntz").period(text) == plain[text] * 1_000_000


@pytest.mark.parametrize("text", ["", "1", "1 parsec", "1h 30", "1:75", "00:00:61", "1..5 s", "0.5 us", "min s", "5 5 s"])
def test_periods_that_say_nothing(text):
    with pytest.raises(ValueError):
        Axis("ntz").period(text)
