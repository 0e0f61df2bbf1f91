"""From raw rows to observations: one row per series and time, its signal, and whether it is a genuine observation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.axis import Axis


def keep_first(data: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, in ``order``, for each combination of ``keys``."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return data.withColumn("_first", first).filter(F.col("_first") == 1).drop("_first")


def as_number(name: str, dtype: T.DataType) -> Column:
    """The value as a double, null where it is none. Infinities are numbers; suffixes such as in 1.0d are not."""
    value = F.col(name)
    if isinstance(dtype, T.StringType):
        value = F.when(~value.rlike(r"[0-9.][dDfF]\s*$"), value.try_cast("double"))
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        value = value.cast("double")
    else:
        value = value.try_cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def prepare(data: DataFrame, time_col: str, value_col: str, series_cols: Sequence[str] = (), quality_col: str | None = None, valid_quality_flags: Iterable | None = None, order_col: str | None = None) -> tuple[DataFrame, Axis]:
    """(``series_cols``, t, signal, observed), and the axis of t.

    The first row at a time stands, in the order of ``order_col``, before any is judged; without that column, ties are
    broken by the other columns in turn. A row is observed if its value is a number and its quality one of the flags.
    """
    for name, what in ((value_col, "value"), (quality_col, "quality"), (time_col, "time")):
        if name is not None and name not in data.columns:
            raise KeyError(f"the table has no {what} column {name!r}")
    axis = Axis.of(data.schema[time_col].dataType)
    if quality_col is not None and valid_quality_flags is None:
        raise ValueError("a quality_col says nothing without valid_quality_flags")
    order = [order_col] if order_col else [c for c in (value_col, quality_col) if c]
    used = dict.fromkeys([*series_cols, time_col, value_col, *([quality_col] if quality_col else []), *order])
    rows = keep_first(data.select(*used).withColumn("_t", axis.encode(time_col)), [*series_cols, "_t"], order)
    value = as_number(value_col, data.schema[value_col].dataType)
    valid = value.isNotNull()
    if quality_col is not None:
        flags = set(valid_quality_flags)
        good = F.coalesce(F.col(quality_col).isin([f for f in flags if f is not None]), F.lit(False))
        valid = valid & (good | F.col(quality_col).isNull() if None in flags else good)
    return rows.select(*series_cols, F.col("_t").alias("t"), F.when(valid, value).alias("signal"), valid.alias("observed")), axis
