"""Folds and running values over arrays.

The engine copies a fold's whole state at every step, so a fold that carries its output costs the square of its length: ``gathered`` is
for blocks of bounded length. ``scanned`` gives running values of arrays of any length, with states that are single numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], rest: Callable[[Column], Column]) -> Column:
    """A fold that carries a state from item to item and puts out arrays of ``kind``, joined in order. ``step`` gives the next
    state and what is put out for an item, ``rest`` what is put out at the end."""
    start = F.struct(state.alias("state"), F.expr(f"cast(array() AS array<{kind}>)").alias("out"))

    def add(a: Column, x: Column) -> Column:
        after, out = step(a["state"], x)
        return F.struct(after.alias("state"), F.concat(a["out"], out).alias("out"))

    return F.aggregate(items, start, add, lambda a: F.concat(a["out"], rest(a["state"])))


#: Elements that a running value is made of at each of its levels.
FAN = 32


def scanned(rows: DataFrame, names: list[str], combine: Callable[[Column, Column], Column], zero: int) -> DataFrame:
    """Adds, for each array of whole numbers ``name``, the array ``name_scan`` of its running sums or maxima.

    Totals of FAN elements, and of FAN such totals, are made first; a running value is then a total of the groups before, of the
    blocks before in its group, and of the elements before in its block. So an element costs some FAN steps, and only
    the groups, a thousandth of the elements, are met by each other. Each level is a column of its own and is read twice,
    which keeps the optimizer from putting its making into the loops that read it.
    """
    none = F.expr("cast(array() AS array<int>)")
    total = lambda part: F.aggregate(part, F.lit(zero), combine)
    places = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    within = lambda i: F.floor(i / FAN).cast("int")

    def level(name: str) -> Column:
        return F.when(F.size(name) > 0, F.transform(places(F.ceil(F.size(name) / FAN)), lambda b: total(F.slice(name, b * FAN + 1, F.lit(FAN))))).otherwise(none)

    def offsets(name: str, above: str | None) -> Column:
        """What lies before each element: before its block by ``above``, and in its block."""
        if above is None:
            own = F.transform(places(F.size(name)), lambda i: total(F.slice(name, F.lit(1), i)))
            return F.when(F.size(name) > 0, own).otherwise(none)
        own = F.transform(places(F.size(name)), lambda i: combine(F.get(F.col(above), within(i)), total(F.slice(name, within(i) * FAN + 1, i - within(i) * FAN))))
        return F.when((F.size(name) > 0) & (F.size(above) > 0), own).otherwise(none)

    keep = rows.columns
    steps = [("1", lambda n: level(n)), ("2", lambda n: level(f"{n}_1")), ("3", lambda n: offsets(f"{n}_2", None)), ("4", lambda n: offsets(f"{n}_1", f"{n}_3")), ("5", lambda n: offsets(n, f"{n}_4"))]
    for suffix, made in steps:
        rows = rows.withColumns({f"{n}_{suffix}": made(n) for n in names})
    rows = rows.withColumns({f"{n}_scan": F.zip_with(f"{n}_5", n, combine) for n in names})
    return rows.select(*keep, *[f"{n}_scan" for n in names])
