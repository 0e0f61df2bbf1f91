"""What must not depend on how long one series is: medians, scores of long histories, merged windows; and streams."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark import detect_energy_anomalies
from wavelark.functions.axis import Axis
from wavelark.functions.checks import Options
from wavelark.functions.sliding import Ordered, SlidingSpread
from wavelark.operators import grid, periods, score, select
from wavelark.streaming import detect as streaming


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_ordered_numbers_of_doubles(spark):
    values = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 0.1, 1 / 3, 0.5, 1.0, 1.5, math.pi, 1e15 + 0.5, 1e300, 1.7976931348623157e308]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", select.to_ordered(F.col("v")).alias("n")).withColumn("back", select.from_ordered(F.col("n")))
    found = rows.orderBy("v").collect()
    assert [r["back"] for r in found] == values and [r["n"] for r in found] == [int(np.float64(v).view(np.int64)) for v in values]


def test_median_of_a_million_distinct_gaps_in_one_series(spark):
    # Gaps i + 1 in an order that is far from sorted: times are running sums, dealt over the whole axis.
    n = 1_000_000
    gaps = (np.arange(n, dtype=np.int64) * 7_919) % n + 1
    times = np.concatenate([[0], np.cumsum(gaps)])
    path = spark.conf.get("spark.checkpoint.dir") + "/million.parquet"
    import pandas as pd

    pd.DataFrame({"t": times}).to_parquet(path)
    rows = spark.read.parquet(path).select("t", F.lit(1.0).alias("signal"), F.lit(True).alias("observed"))
    found = grid.estimate_periods(rows, [], Axis("ntz"))
    assert found.first()["period"] == math.floor(np.median(gaps))
    assert not {"median(", "percentile"} & {w for w in ("median(", "percentile") if w in plan_of(found).lower()}


@pytest.mark.parametrize("kind", ["ntz", "numeric"])
def test_inferred_periods(spark, kind, monkeypatch):
    monkeypatch.setattr(select, "SPAN_ROWS", 8)  # many spans, divided again
    rng = np.random.default_rng(3)
    rows, want, n_gaps = [], {}, 0
    for s, n in (("a", 2), ("b", 3), ("c", 400), ("d", 57), ("burst", 300)):
        gap = rng.integers(1, 50, n - 1) if kind == "ntz" else rng.random(n - 1) * 10.0 ** rng.integers(-6, 6, n - 1)
        if s == "burst":
            gap = np.where(np.arange(n - 1) == 150, gap * 10**9, gap)
        t = np.concatenate([[5], 5 + np.cumsum(gap)])
        rows += [(s, x.item()) for x in t]
        n_gaps += int((np.diff(t) > 0).sum())
        middle = np.median(np.diff(t)[np.diff(t) > 0])
        want[s] = math.floor(middle) if kind == "ntz" else middle
    df = spark.createDataFrame(rows, f"s string, t {'long' if kind == 'ntz' else 'double'}").repartition(5)
    found = grid.estimate_periods(df.withColumn("signal", F.lit(1.0)), ["s"], Axis(kind)).collect()
    assert {r["s"]: r["period"] for r in found} == want
    assert select.gaps(df, ["s"], "t").count() == n_gaps


def test_numbers_in_order():
    rng = np.random.default_rng(1)
    kept, plain = Ordered(), []
    for i in range(4000):
        x = float(rng.integers(0, 300)) if i % 2 else float(rng.random())
        kept.add(x)
        plain.append(x)
        if i % 3 == 2:
            gone = plain.pop(int(rng.integers(len(plain))))
            kept.remove(gone)
    plain.sort()
    assert [kept.at(i) for i in range(len(kept))] == plain and len(kept.blocks) > 5
    assert all(kept.below(x) == int(np.searchsorted(plain, x)) for x in (-1.0, 0.0, 0.5, 7.0, 299.0, 1e9))


@pytest.mark.parametrize("size", [1, 2, 5, 64, 777])
def test_sliding_spread_is_that_of_the_values(size):
    rng = np.random.default_rng(size)
    kept, plain = SlidingSpread(size), []
    for i in range(1500):
        x = [float(rng.integers(0, 4)), float(rng.normal()), float("nan") if i % 200 == 7 else 1.0, float("inf") if i % 150 == 3 else 2.0][i % 4]
        kept.append(x)
        plain = [*plain, x][-size:]
        base = np.median(plain)
        with np.errstate(invalid="ignore"):
            mad = np.median(np.abs(np.array(plain) - base))
        assert np.array_equal(kept.spread(), (base, mad), equal_nan=True)


def plain_scores(energies, o):
    """One pass over lists, with NumPy's medians."""
    past, out = [], []
    for e in energies:
        found = None
        if len(past) >= o.min_history:
            base = np.median(past)
            mad = np.median(np.abs(np.array(past) - base))
            found = (e - base) / max(1.4826 * mad, np.finfo(float).eps * max(1.0, abs(base)))
        out.append(found)
        if o.history_policy == "all" or found is None or not abs(found) > o.k:
            past = [*past, e][-o.history_size :]
    return out


@pytest.mark.parametrize("policy", ["exclude_suspicious", "all"])
def test_chunks_judged_at_once_are_one_pass(spark, monkeypatch, policy):
    monkeypatch.setattr(score, "CHUNK_WINDOWS", 100)
    monkeypatch.setattr(score, "LONG_HISTORY", 3)
    rng = np.random.default_rng(9)
    n, o = 2000, Options(history_size=30, min_history=4, k=4.0, history_policy=policy)
    series = {"plain": np.where(rng.random(n) < 0.1, 30.0, 1.0) + rng.random(n), "steps": np.repeat([1.0, 50.0, 2.0, 900.0], n // 4) + rng.random(n)}
    gone = {7, 8, 9, *range(300, 520), 1999}  # windows that were rejected: whole chunks are missing
    rows = [(s, i, float(e)) for s, values in series.items() for i, e in enumerate(values) if i not in gone]
    counted, judge = [], score.judged_chunks

    def counting(chunks, *more):
        out = judge(chunks, *more)
        counted.append(chunks.count())
        return out

    monkeypatch.setattr(score, "judged_chunks", counting)
    df = spark.createDataFrame(rows, "s string, window_id long, energy double").repartition(7)
    got = {(r["s"], r["window_id"]): r["score"] for r in score.score(df, ["s"], o).collect()}
    for s in series:
        own = [(i, e) for t, i, e in rows if t == s]
        want = plain_scores([e for _, e in own], o)
        assert [got[s, i] for i, _ in own] == want
    assert counted[0] == 36  # each chunk is a row of its own, not a series
    if policy == "all":
        assert len(counted) <= 2 and sum(counted[1:]) <= 2
    else:
        assert len(counted) > 1 and counted[1] < 36


def test_a_long_history_is_judged_in_order(spark, monkeypatch):
    rng = np.random.default_rng(4)
    energies = rng.gamma(2.0, size=3000)
    o = Options(history_size=1000, min_history=500, k=3.0, history_policy="all")
    rows = spark.createDataFrame([(i, float(e)) for i, e in enumerate(energies)], "window_id long, energy double")
    new = score.score(rows, [], o).orderBy("window_id").collect()
    old = score.against_all(rows, [], o).orderBy("window_id").collect()
    for c in score.SCORES:
        assert [r[c] for r in new] == [r[c] for r in old]


def windows_of(spark, at, length, change=None):
    """Windows at the given places of a signal that is a hash of the place; masks are those of the place."""
    value = lambda x: math.sin(x * 12.9898)
    result = spark.createDataFrame([("s", i, a, a + length, True, False) for i, a in enumerate(at)], "s string, window_id long, grid_start long, grid_stop long, accepted boolean, suspicious boolean")
    rows = [("s", i, list(range(a, a + length)), [value(x) + (change or {}).get((i, x), 0.0) for x in range(a, a + length)], [(x + i) % 3 > 0 for x in range(a, a + length)], [x % 5 == 1 for x in range(a, a + length)]) for i, a in enumerate(at)]
    return result, spark.createDataFrame(rows, "s string, window_id long, time array<long>, signal array<double>, observed_mask array<boolean>, interpolated_mask array<boolean>")


@pytest.mark.parametrize("block", [4, 7, 64, 4096])
def test_windows_merged_by_block(spark, monkeypatch, block):
    monkeypatch.setattr(periods, "BLOCK", block)
    at = [0, 2, 4, 4, 9, 30, 33, 60, 61, 62, 80]
    result, windows = windows_of(spark, at, 9)
    got = {r["pos"]: r for r in periods.sample_index(result, windows, ["s"]).collect()}
    want = {}
    for i, a in enumerate(at):
        for x in range(a, a + 9):
            seen = want.get(x)
            want[x] = (math.sin(x * 12.9898), (x + i) % 3 > 0 or bool(seen and seen[1]), x % 5 == 1)
    assert len(got) == len(want) and all((r["time"], r["signal"], r["observed"], r["interpolated"]) == (x, *want[x]) for x, r in got.items())
    for where in ((1, 10), (4, 12), (6, 34)):  # a difference anywhere in what two windows share is found
        with pytest.raises(ValueError, match="inconsistent"):
            periods.sample_index(*windows_of(spark, at, 9, {where: 1e-6}), ["s"])
    periods.sample_index(*windows_of(spark, at, 9, {(1, 10): 1e-13, (7, 60): 5.0}), ["s"])  # rounding, and a sample of one window alone


def hourly(n=400, seed=2, series=("a", "b")):
    rng = np.random.default_rng(seed)
    start, rows = dt.datetime(2025, 3, 1), []
    for s in series:
        values = np.sin(np.arange(n) / 4) + rng.normal(0, 0.1, n) + np.where((np.arange(n) > 250) & (np.arange(n) < 270), 6.0 * (s == "a"), 0)
        for i in range(n):
            if rng.random() > 0.06 and not 120 < i < 128:
                rows.append((s, start + dt.timedelta(hours=i), float(values[i]), "bad" if rng.random() < 0.03 else "good", i))
        rows.append((s, rows[-1][1], 99.0, "good", n + 5))  # a second row of one time
    return sorted(rows, key=lambda r: (r[1], r[4]))


SCHEMA = "s string, time timestamp_ntz, value double, quality string, ord long"
MORE = {"series_cols": ["s"], "quality_col": "quality", "valid_quality_flags": ["good"], "order_col": "ord", "sampling_period": "1 hour", "window_size": 24, "overlap": 12, "min_valid_ratio": 0.6, "history_size": 8, "min_history": 3}


@pytest.fixture
def store(spark):
    spark.conf.set(*streaming.STORE)
    yield
    spark.conf.unset(streaming.STORE[0])


def write(spark, rows, folder, i):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    os.utime(folder, None)


def replay(spark, folder, delay):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = streaming.detect_stream(stream, delay=delay, **MORE).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return query



def test_a_replayed_stream_gives_the_rows_of_the_batch(spark, store, tmp_path):
    rows = hourly()
    batch = detect_energy_anomalies(spark.createDataFrame(rows, SCHEMA), **MORE)[0]
    want = sorted((tuple(r[c] for c in sorted(batch.columns)) for r in batch.collect()), key=str)
    assert any(r["suspicious"] for r in batch.collect())
    # Rows in files of their own order, a little disordered between files; the restart goes on from the checkpoint.
    cut = [rows[i : i + 200] for i in range(0, len(rows), 200)]
    cut[1][:3], cut[0][-3:] = cut[0][-3:], cut[1][:3]
    for i, part in enumerate(cut[:2]):
        write(spark, part, tmp_path, i)
    replay(spark, tmp_path, "12 hours")
    early = spark.read.parquet(f"{tmp_path}/out").count()
    for i, part in enumerate(cut[2:]):
        write(spark, part, tmp_path, 2 + i)
    end = rows[-1][1] + dt.timedelta(days=40)  # a later row lets the watermark pass the rest
    write(spark, [("later", end, 0.0, "good", 0)], tmp_path, 99)
    late = [("a", rows[10][1], 55.0, "good", -1)]
    replay(spark, tmp_path, "12 hours")
    write(spark, late, tmp_path, 100)
    replay(spark, tmp_path, "12 hours")
    out = spark.read.parquet(f"{tmp_path}/out").filter("s <> 'later'")
    assert 0 < early < len(want)
    got = sorted((tuple(r[c] for c in sorted(batch.columns)) for r in out.collect()), key=str)
    assert got == want


def test_stream_checks(spark):
    rows = spark.createDataFrame(hourly(5), SCHEMA)
    with pytest.raises(ValueError, match="series_cols"):
        streaming.detect_stream(rows, **MORE | {"series_cols": []})
    with pytest.raises(TypeError):
        streaming.detect_stream(rows.withColumn("time", F.col("ord")), **MORE)
    with pytest.raises(ValueError, match="overlap"):
        streaming.detect_stream(rows, **MORE | {"overlap": 24})
