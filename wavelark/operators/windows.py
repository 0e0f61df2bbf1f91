"""Windows of a fixed count of grid positions: membership, completeness, and energy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..functions.axis import Axis
from ..functions.checks import Options


def membership(filled: DataFrame, grids: DataFrame, series_cols: Sequence[str], o: Options) -> DataFrame:
    """A row for each position and each window that holds it. Only whole windows exist; a rest at the end is left out.

    This is the long form, for reports; ``measured`` builds windows without a row for each membership.
    """
    rows = filled.join(grids.select(*series_cols, "n"), list(series_cols)) if series_cols else filled.crossJoin(F.broadcast(grids.select("n")))
    first = F.greatest(F.ceil((F.col("pos") - o.window_size + 1) / o.step), F.lit(0)).cast("long")
    last = F.least(F.floor(F.col("pos") / o.step), F.floor((F.col("n") - o.window_size) / o.step)).cast("long")
    rows = rows.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last")
    return rows.withColumn("window_id", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last", "n")


#: Positions that a block of windows has at least, beside those it shares with the next block.
BLOCK = 4096


def blocks(filled: DataFrame, series_cols: Sequence[str], o: Options) -> tuple[DataFrame, int]:
    """(``series_cols``, _block, _all): the samples of blocks of windows, in order, and the number of windows of a block."""
    keys, step, size = list(series_cols), o.step, o.window_size
    many = -(-max(BLOCK, size) // step)
    own = F.floor(F.col("pos") / (many * step)).cast("long")
    shared = (F.col("pos") - own * (many * step) < size - step) & (own > 0)
    dealt = F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))
    sample = F.struct("pos", "t", "filled", "observed", "interpolated")
    return filled.withColumn("_block", F.explode(dealt)).groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(sample)).alias("_all")), many


def arrays(filled: DataFrame, series_cols: Sequence[str], o: Options) -> DataFrame:
    """(``series_cols``, window_id, _s): the samples of each whole window, in order.

    Positions are gathered in blocks of windows, so that a sample moves once, or twice where two blocks share it, however
    many windows hold it; windows are then slices of a block. Every position of the grid is there, so a full slice is a
    whole window.
    """
    rows, many = blocks(filled, series_cols, o)
    step, size = o.step, o.window_size
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).filter(F.col("_i") * step + size <= F.size("_all"))
    return rows.select(*series_cols, (F.col("_block") * many + F.col("_i")).alias("window_id"), F.slice("_all", F.col("_i") * step + 1, F.lit(size)).alias("_s"))


#: Windows that a sample lies in from which on windows are measured a block at a time, where the taper is a sum of cosines.
DENSE = 16


def is_dense(o: Options) -> bool:
    return o.window_size >= DENSE * o.step and dense.cosine_coefficients(o.window_name) is not None


def measured_densely(filled: DataFrame, series_cols: Sequence[str], axis: Axis, o: Options) -> DataFrame:
    """What ``measured`` gives of each window, but for its samples: times of its ends, counts, why it is rejected, energy.

    A block's windows are measured together, so a window costs as much with a hundred samples as with a hundred thousand; an
    energy may differ from that of ``measured`` in the last digits.
    """
    rows, many = blocks(filled, series_cols, o)
    weights, step, size = dense.cosine_coefficients(o.window_name), o.step, o.window_size
    keys = list(series_cols)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    part = lambda name: F.col(f"_all.{name}").alias(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = dict(zip(b.schema.names, b.columns, strict=True))
            for i in range(b.num_rows):
                column = lambda name, i=i, own=own: own[name].slice(i, 1).flatten()
                t, signal, observed, interpolated = column("t").to_numpy(), column("filled").to_numpy(zero_copy_only=False).astype(float), *(column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("observed", "interpolated"))
                starts = np.arange(0, min(many * step, len(t) - size + 1), step)
                if not len(starts):
                    continue
                null = column("filled").is_null().to_numpy(zero_copy_only=False)
                count = lambda mask, starts=starts: dense.window_sums(mask.astype(np.int64), size, starts)
                found = {"window_id": own["_block"][i].as_py() * many + np.arange(len(starts)), "t0": t[starts], "t1": t[starts + size - 1], "observed_samples": count(observed), "interpolated_samples": count(interpolated), "longest_missing_run": dense.longest_runs(~observed, size, starts), "_null": count(null), "energy": dense.energies(signal, size, starts, weights)}
                names = [*keys, *found]
                yield pa.RecordBatch.from_arrays([*(own[k].take(pa.array(np.full(len(starts), i))) for k in keys), *map(pa.array, found.values())], names)

    time = types["_all"].split("t:")[1].split(",")[0]
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + f"window_id long, t0 {time}, t1 {time}, observed_samples long, interpolated_samples long, longest_missing_run long, _null long, energy double"
    rows = rows.select(*keys, "_block", *map(part, ("t", "filled", "observed", "interpolated"))).mapInArrow(run, schema)
    rows = rows.select(
        *keys, "window_id", axis.decode(F.col("t0")).alias("start_time"), axis.decode(F.col("t1")).alias("end_time"),
        (F.col("window_id") * step).alias("grid_start"), (F.col("window_id") * step + size).alias("grid_stop"), F.lit(size).alias("expected_samples"),
        *[F.col(c).cast("int").alias(c) for c in ("observed_samples", "interpolated_samples", "longest_missing_run")], "_null", "energy",
    )
    rows = judged(rows, F.col("_null") > 0, o)
    return rows.withColumn("energy", F.when(F.col("accepted"), F.col("energy"))).drop("_null")


def judged(rows: DataFrame, unfilled: Column, o: Options) -> DataFrame:
    """Adds valid_ratio, rejection_reason and accepted to windows that are counted."""
    rows = rows.withColumn("valid_ratio", F.col("observed_samples") / F.col("expected_samples"))
    reasons = F.concat_ws(
        ";",
        F.when(F.col("valid_ratio") < o.min_valid_ratio, "insufficient_valid_ratio"),
        F.when(F.col("observed_samples") < (o.min_valid_samples or 0), "insufficient_valid_samples"),
        F.when(F.col("longest_missing_run") > o.max_interpolation_gap, "gap_too_long"),
        F.when(unfilled, "unfilled_missing_values"),
    )
    return rows.withColumn("rejection_reason", F.nullif(reasons, F.lit(""))).withColumn("accepted", F.col("rejection_reason").isNull())


def total(values: Column) -> Column:
    """Sum in the order of the array, so that it is the same for every partitioning."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def longest_run(mask: Column) -> Column:
    """The longest run of false in an array of booleans."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, seen: Column) -> Column:
        run = F.when(seen, 0).otherwise(a["run"] + 1)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(mask, start, step, lambda a: a["best"])


def measured(filled: DataFrame, series_cols: Sequence[str], axis: Axis, o: Options, taper: list[float]) -> DataFrame:
    """One row per window: its samples as ordered arrays, its counts, why it is rejected, and its energy if it is not."""
    size = F.lit(o.window_size)
    rows = arrays(filled, series_cols, o).select(
        *series_cols, "window_id",
        F.transform("_s", lambda x: axis.decode(x["t"])).alias("time"), F.col("_s.filled").alias("signal"), F.col("_s.observed").alias("observed_mask"), F.col("_s.interpolated").alias("interpolated_mask"),
    )
    count = lambda mask: F.size(F.filter(mask, lambda x: x))
    rows = rows.select(
        "*",
        (F.col("window_id") * o.step).alias("grid_start"), (F.col("window_id") * o.step + size).alias("grid_stop"), size.alias("expected_samples"),
        count("observed_mask").alias("observed_samples"), count("interpolated_mask").alias("interpolated_samples"), longest_run(F.col("observed_mask")).alias("longest_missing_run"),
    )
    rows = judged(rows, F.exists("signal", lambda x: x.isNull()), o)
    weights = F.array(*map(F.lit, taper))
    power = sum(w * w for w in taper)
    rows = rows.withColumn("_mean", F.when(F.col("accepted"), total(F.col("signal")) / o.window_size))
    rows = rows.withColumn("centered", F.when(F.col("accepted"), F.transform("signal", lambda x: x - F.col("_mean"))))
    rows = rows.withColumn("windowed", F.when(F.col("accepted"), F.zip_with("centered", weights, lambda x, w: x * w)))
    return rows.withColumn("energy", F.when(F.col("accepted"), total(F.transform("windowed", lambda x: x * x)) / power)).drop("_mean")
