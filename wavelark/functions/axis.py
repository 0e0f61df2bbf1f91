"""Time axes: a column of any supported type as an exact internal number, and back.

Timestamps and intervals become whole microseconds (bigint), independent of the session's time zone; numeric axes stay
doubles. Finer than a microsecond is not representable here.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import timedelta
from decimal import Decimal, InvalidOperation
from numbers import Real

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Microseconds of the units that a period can be written in.
UNITS = {
    "us": 1, "microsecond": 1, "ms": 1_000, "millisecond": 1_000, "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000,
    "m": 60_000_000, "min": 60_000_000, "minute": 60_000_000, "h": 3_600_000_000, "hr": 3_600_000_000, "hour": 3_600_000_000,
    "d": 86_400_000_000, "day": 86_400_000_000, "w": 604_800_000_000, "week": 604_800_000_000,
}
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


@dataclass(frozen=True)
class Axis:
    """How one type of time column is read and written. ``kind``: ntz, instant, interval or numeric."""

    kind: str

    @staticmethod
    def of(dtype: T.DataType) -> Axis:
        if isinstance(dtype, T.TimestampNTZType):
            return Axis("ntz")
        if isinstance(dtype, (T.TimestampType, T.DateType)):
            return Axis("instant")
        if isinstance(dtype, T.DayTimeIntervalType):
            return Axis("interval")
        if isinstance(dtype, (T.NumericType, T.BooleanType)):
            return Axis("numeric")
        raise TypeError(f"a time column is a timestamp, an interval or a number, not {dtype.simpleString()}")

    @property
    def timed(self) -> bool:
        return self.kind != "numeric"

    def encode(self, name: str) -> Column:
        quoted = f"`{name}`"
        micros = "cast(cast(cast({} AS interval day to second) AS interval second) AS decimal(20, 6)) * 1000000"
        if self.kind == "ntz":
            return F.expr(f"cast({micros.format(f'({quoted} - {_EPOCH})')} AS bigint)")
        if self.kind == "interval":
            return F.expr(f"cast({micros.format(quoted)} AS bigint)")
        if self.kind == "instant":
            return F.unix_micros(F.col(name).cast("timestamp"))
        return F.col(name).cast("double")

    def decode(self, number: Column) -> Column:
        """The axis value of an internal number; a null gives null."""
        if self.kind == "ntz":
            whole = F.expr(_EPOCH)
            return whole + self._interval(number)
        if self.kind == "instant":
            return F.timestamp_micros(number)
        return self._interval(number) if self.kind == "interval" else number

    @staticmethod
    def _interval(micros: Column) -> Column:
        return F.make_dt_interval(secs=(micros.cast("decimal(20, 0)") / F.lit(1_000_000).cast("decimal(7, 0)")).cast("decimal(18, 6)"))

    def period(self, given) -> int | float:
        """A sampling period as an internal number. Bare numbers on a time axis are refused: their unit is unclear."""
        if not self.timed:
            if isinstance(given, bool) or not isinstance(given, Real) or not math.isfinite(given) or given <= 0:
                raise ValueError(f"on a numeric axis the sampling_period is a finite number above 0, not {given!r}")
            return float(given)
        if isinstance(given, timedelta):
            micros = given // timedelta(microseconds=1)
        elif isinstance(given, str):
            micros = _parsed(given)
        else:
            raise ValueError("sampling_period on a time axis must be a timedelta or a text with a unit")
        if micros <= 0:
            raise ValueError("sampling_period must be positive")
        return micros


PART = re.compile(r"([+-]?\d*\.?\d*)\s*([A-Za-z]+)\s*(?:,\s*)?")
CLOCK = re.compile(r"([+-]?)(\d+):(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?\s*$")


def _parsed(text: str) -> int:
    """Microseconds of numbers with units, of a clock time, or of both: ``1 hour``, ``1h30min``, ``00:00:01.5``, ``1 days 02:00:00``."""
    unknown = ValueError(f"cannot read the sampling_period {text!r}")
    rest, total, parts = text.strip(), Decimal(0), 0
    while rest and not CLOCK.match(rest):
        found = PART.match(rest)
        if not found or (parts and not found[1]):
            raise unknown
        unit = found[2].lower()
        size = UNITS.get(unit) or UNITS.get(unit.removesuffix("s"))
        if size is None:
            raise ValueError(f"unknown unit in the sampling_period {text!r}")
        try:
            total += Decimal(found[1] if found[1] not in ("", "+", "-") else found[1] + "1") * size
        except InvalidOperation:
            raise unknown from None
        rest, parts = rest[found.end() :], parts + 1
    if rest:
        sign, hours, minutes, seconds = CLOCK.match(rest).groups()
        seconds = Decimal(seconds or 0)
        if int(minutes) > 59 or seconds >= 60:
            raise unknown
        clock = int(hours) * UNITS["h"] + int(minutes) * UNITS["min"] + seconds * UNITS["s"]
        total += -clock if sign == "-" else clock
    elif not parts:
        raise unknown
    if total != int(total):
        raise ValueError("a sampling_period finer than a microsecond is not supported")
    return int(total)
