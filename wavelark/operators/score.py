"""Robust scores of window energies against the windows before them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.checks import Options
from ..functions.sliding import SlidingSpread
from ..sources.workspace import Workspace

#: The factor that makes the median absolute deviation of normal values their standard deviation.
MAD_SCALE = 1.4826
EPS = float(np.finfo(float).eps)
SCORES = ["baseline", "mad", "robust_scale", "score"]


def median(values: Column) -> Column:
    """Exact median of an array; not a number if any element is none."""
    s = F.sort_array(values)
    n = F.size(values)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when(F.exists(values, F.isnan), F.lit(float("nan"))).otherwise(middle)


def against_all(rows: DataFrame, series_cols: Sequence[str], o: Options) -> DataFrame:
    """Scores against the last ``history_size`` accepted windows, suspicious ones too: a bounded window frame."""
    frame = W.partitionBy(*series_cols).orderBy("window_id").rowsBetween(-o.history_size, -1)
    rows = rows.withColumn("_past", F.collect_list("energy").over(frame))
    warm = F.size("_past") >= o.min_history
    rows = rows.withColumn("baseline", F.when(warm, median(F.col("_past"))))
    rows = rows.withColumn("_far", F.transform("_past", lambda x: F.abs(x - F.col("baseline"))))
    rows = rows.withColumn("mad", F.when(warm, median(F.col("_far"))))
    scale = F.when(F.isnan("mad"), F.col("mad")).otherwise(F.greatest(MAD_SCALE * F.col("mad"), EPS * F.greatest(F.lit(1.0), F.abs("baseline"))))
    rows = rows.withColumn("robust_scale", F.when(warm, scale)).withColumn("score", (F.col("energy") - F.col("baseline")) / F.col("robust_scale"))
    return rows.drop("_past", "_far")


class History:
    """The energies that a series' next window is held against: the last ``history_size``, under the default policy of those
    that were not suspicious. Kept in order, so a window costs little more in a long history than in a short one."""

    def __init__(self, o: Options, entry: Iterable[float] = ()) -> None:
        self.o, self.past = o, SlidingSpread(o.history_size, entry)

    def judge(self, energy: float) -> tuple[float, float, float, float] | None:
        """Baseline, deviation, scale and score of the next energy, or None while there is too little history; the energy
        then joins the history, if the policy lets it."""
        found = None
        if len(self.past) >= self.o.min_history:
            base, mad = self.past.spread()
            scale = mad if np.isnan(mad) else max(MAD_SCALE * mad, EPS * max(1.0, abs(base)))
            found = (base, mad, scale, float(np.divide(energy - base, scale)))
        if self.o.history_policy == "all" or found is None or not abs(found[3]) > self.o.k:
            self.past.append(energy)
        return found


#: Window ids of a chunk that a task judges as a whole.
CHUNK_WINDOWS = 16_384


def _types(rows: DataFrame, names: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return "".join(f"`{k}` {types[k]}, " for k in names)


def streamed(slim: DataFrame, series_cols: Sequence[str], o: Options) -> DataFrame:
    """Scores of (``series_cols``, window_id, energy), each series in one task, which holds one history."""
    keys = [*series_cols, "window_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, history = None, History(o)
        for b in batches:
            own = list(zip(*(b.column(i).to_pylist() for i in range(len(keys) - 1)), strict=True)) if len(keys) > 1 else [()] * b.num_rows
            found = []
            for key, energy in zip(own, b.column(len(keys)).to_pylist(), strict=True):
                if key != series:
                    series, history = key, History(o)
                found.append(history.judge(energy))
            scores = [pa.array([None if f is None else float(f[i]) for f in found], pa.float64()) for i in range(len(SCORES))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *scores], [*keys, *SCORES])

    dealt = slim.repartition(*series_cols) if series_cols else slim.repartition(1)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, _types(slim, keys) + ", ".join(f"{s} double" for s in SCORES))


def judged_chunks(chunks: DataFrame, series_cols: Sequence[str], o: Options) -> DataFrame:
    """Each chunk (``series_cols``, chunk, ids, energies) judged from its ``entry``, the history before it: adds ``exit``,
    the history after it, and the scores as arrays."""
    keys = [*series_cols, "_chunk"]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubles = pa.list_(pa.float64())
        for b in batches:
            exits, scores = [], [[] for _ in SCORES]
            for entry, energies in zip(b.column(n).to_pylist(), b.column(n + 2).to_pylist(), strict=True):
                history = History(o, entry)
                found = [history.judge(e) for e in energies]
                exits.append(list(history.past.values))
                for i, part in enumerate(scores):
                    part.append([None if f is None else float(f[i]) for f in found])
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 2], pa.array(exits, doubles), *(pa.array(s, doubles) for s in scores)], [*keys, "_entry", "_ids", "_exit", *SCORES])

    schema = _types(chunks, [*keys, "_entry", "_ids"]) + ", ".join(f"{s} array<double>" for s in ("_exit", *SCORES))
    return chunks.select(*keys, "_entry", "_ids", "_energies").mapInArrow(run, schema)


def speculated(slim: DataFrame, series_cols: Sequence[str], o: Options, work: Workspace) -> DataFrame:
    """Scores of long series, chunk by chunk at once.

    A chunk's entry is first guessed: the last energies of the chunk before it, as if all were regular. Then the chunks
    whose entry was not the exit of the chunk before are judged anew, until there are none. A chunk forgets what lies
    ``history_size`` regular windows back, so a wrong guess hardly ever goes beyond one chunk; were all to go on, each round
    still settles one more chunk of each series. What a round decides on is one history for each chunk.
    """
    keys = [*series_cols, "_chunk"]
    window = F.struct("window_id", "energy")
    chunks = slim.groupBy(*series_cols, F.floor(F.col("window_id") / CHUNK_WINDOWS).alias("_chunk")).agg(F.sort_array(F.collect_list(window)).alias("_w"))
    chunks = work.keep(chunks.select(*keys, F.col("_w.window_id").alias("_ids"), F.col("_w.energy").alias("_energies")), "chunks")
    order = W.partitionBy(*series_cols).orderBy("_chunk")
    before = lambda name: F.coalesce(F.lag(name).over(order), F.expr("cast(array() AS array<double>)"))
    tail = F.slice("_energies", F.greatest(F.size("_energies") - o.history_size, F.lit(0)) + 1, F.lit(o.history_size))
    entries = chunks.select(*keys, tail.alias("_tail")).select(*keys, before("_tail").alias("_entry"))
    rounds: list[DataFrame] = []
    state = None
    while True:
        rounds.append(work.keep(judged_chunks(chunks.join(entries, keys), series_cols, o), f"round{len(rounds)}"))
        last = rounds[-1].select(*keys, "_entry", "_exit", F.lit(len(rounds) - 1).alias("_round"))
        state = work.keep(last if state is None else state.join(last, keys, "left_anti").unionByName(last), "state")
        wrong = state.withColumn("_due", before("_exit")).filter(F.col("_due") != F.col("_entry"))
        entries = work.keep(wrong.select(*keys, F.col("_due").alias("_entry")), "entries")
        if entries.isEmpty():
            break
    final = [r.join(state.filter(F.col("_round") == i).select(*keys), keys, "left_semi") for i, r in enumerate(rounds)]
    rows = reduce(DataFrame.unionByName, final).select(*series_cols, F.explode(F.arrays_zip(F.col("_ids").alias("window_id"), *SCORES)).alias("_s"))
    return rows.select(*series_cols, F.col("_s.window_id").alias("window_id"), *[F.col(f"_s.{c}").alias(c) for c in SCORES])


def against_regular(rows: DataFrame, series_cols: Sequence[str], o: Options) -> DataFrame:
    """Scores where each decision depends on those before it, or where a history is long.

    Window ids and energies are written once. Series of one chunk each stream through their tasks; where a series has more
    chunks, chunks are judged at once from guessed histories.
    """
    keys = [*series_cols, "window_id"]
    work = Workspace(rows.sparkSession)
    slim = work.keep(rows.select(*keys, "energy"), "energies")
    chunk = F.floor(F.col("window_id") / CHUNK_WINDOWS)
    long = slim.groupBy(*series_cols).agg(F.min(chunk).alias("a"), F.max(chunk).alias("b")).filter("a < b").limit(1)
    scored = streamed(slim, series_cols, o) if long.isEmpty() else speculated(slim, series_cols, o, work)
    return rows.join(scored, keys, "left")


#: Histories beyond this are kept in order from window to window; shorter ones are gathered and sorted for each window.
LONG_HISTORY = 256


def score(rows: DataFrame, series_cols: Sequence[str], o: Options) -> DataFrame:
    """Adds the scores and ``suspicious`` to accepted windows (series, window_id, energy). Two-sided and strict."""
    short = o.history_policy == "all" and o.history_size <= LONG_HISTORY
    out = (against_all if short else against_regular)(rows, series_cols, o)
    odd = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") > o.k)
    return out.withColumn("suspicious", F.coalesce(odd, F.lit(False)))
