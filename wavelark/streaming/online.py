"""The first stage of one series, observation by observation: what a stream keeps between batches, and what it puts out.

Nothing here knows of Spark. A series is fed observations in any order and told up to which time they are complete; it puts out
windows as soon as none of their samples can change any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ..functions.checks import Options
from ..operators.score import History

#: (position, order, value or None): an observation that is not yet complete in time; of equal positions the least order stands.
Pending = tuple[int, str, float | None]


@dataclass
class Series:
    """State of one series.

    ``origin`` is the time of position 0, ``reached`` the first position that is not settled. ``signal`` and ``observed`` are settled
    samples from ``start`` on, those that later windows still need; ``last`` is the last sample with a signal.
    """

    origin: int | None = None
    reached: int = 0
    start: int = 0
    last: tuple[int, float] | None = None
    signal: list[float | None] = field(default_factory=list)
    observed: list[bool] = field(default_factory=list)
    filled: list[bool] = field(default_factory=list)
    pending: list[Pending] = field(default_factory=list)
    history: list[float] = field(default_factory=list)
    next_window: int = 0


class Online:
    """Steps of the first stage with fixed options. Times are whole microseconds."""

    def __init__(self, o: Options, period: int, taper: list[float]) -> None:
        self.o, self.period, self.taper = o, period, np.array(taper)
        self.power = sum(w * w for w in taper)

    def add(self, s: Series, t: int, order: str, value: float | None) -> None:
        """An observation; ``value`` is None if it is not valid. Times are kept as they are until the origin is known."""
        s.pending.append((t, order, value))

    def settle(self, s: Series, until: int) -> Iterator[dict]:
        """Windows that are complete once all observations up to the time ``until`` are there.

        Positions after the last observation wait for the next one, so a series never ends in missing samples.
        """
        ready = sorted((p for p in s.pending if p[0] <= until), key=lambda p: p[:2])
        if not ready:
            return
        s.pending = [p for p in s.pending if p[0] > until]
        if s.origin is None:
            s.origin = ready[0][0]
        seen = None
        for t, _, value in ready:
            if t == seen:
                continue
            seen = t
            pos, off = divmod(t - s.origin, self.period)
            if off:
                raise ValueError(f"times are not exactly aligned to the grid: {t} microseconds is {off} after position {pos}")
            for _ in range(s.reached, pos):
                self._sample(s, None)
            self._sample(s, value)
            yield from self._windows(s)

    def _sample(self, s: Series, value: float | None) -> None:
        """The next position's sample; a short run of missing ones before it is filled when it ends."""
        if value is not None and s.last is not None:
            x0, y0 = s.last
            if 0 < s.reached - x0 - 1 <= self.o.max_interpolation_gap:
                for x in range(max(x0 + 1, s.start), s.reached):
                    s.signal[x - s.start] = (value - y0) / (s.reached - x0) * (x - x0) + y0
                    s.filled[x - s.start] = True
        s.signal.append(value)
        s.observed.append(value is not None)
        s.filled.append(False)
        if value is not None:
            s.last = (s.reached, value)
        s.reached += 1

    def _open_from(self, s: Series) -> int:
        """The first position that may still be filled: a short run at the end, after a sample with a signal."""
        if s.last is None:
            return s.reached
        run = s.reached - s.last[0] - 1
        return s.last[0] + 1 if 0 < run <= self.o.max_interpolation_gap else s.reached

    def _windows(self, s: Series) -> Iterator[dict]:
        o, known = self.o, self._open_from(s)
        while s.next_window * o.step + o.window_size <= known:
            a = s.next_window * o.step - s.start
            part = slice(a, a + o.window_size)
            yield self._measure(s, s.signal[part], s.observed[part], s.filled[part])
            s.next_window += 1
            gone = s.next_window * o.step - s.start
            if gone > 0:
                del s.signal[:gone], s.observed[:gone], s.filled[:gone]
                s.start += gone

    def _measure(self, s: Series, signal: list, observed: list[bool], filled: list[bool]) -> dict:
        o, first = self.o, s.next_window * self.o.step
        run = best = 0
        for seen in observed:
            run = 0 if seen else run + 1
            best = max(best, run)
        ratio = sum(observed) / o.window_size
        reasons = [name for name, holds in (("insufficient_valid_ratio", ratio < o.min_valid_ratio), ("insufficient_valid_samples", sum(observed) < (o.min_valid_samples or 0)), ("gap_too_long", best > o.max_interpolation_gap), ("unfilled_missing_values", any(x is None for x in signal))) if holds]
        energy, found = None, None
        if not reasons:
            values = np.array(signal, float)
            centered = values - np.cumsum(values)[-1] / o.window_size  # sums in the order of samples, as elsewhere
            energy = float(np.cumsum((centered * self.taper) ** 2)[-1] / self.power)
            history = History(o, s.history)
            found = history.judge(energy)
            s.history = list(history.past.values)
        scores = dict(zip(("baseline", "mad", "robust_scale", "score"), found or (None,) * 4, strict=True))
        at = lambda pos: s.origin + pos * self.period
        return {
            "window_id": s.next_window, "start_us": at(first), "end_us": at(first + o.window_size - 1), "grid_start": first, "grid_stop": first + o.window_size,
            "expected_samples": o.window_size, "observed_samples": sum(observed), "interpolated_samples": sum(filled), "valid_ratio": ratio, "longest_missing_run": best,
            "accepted": not reasons, "rejection_reason": ";".join(reasons) or None, "energy": energy, **scores,
            "suspicious": bool(found is not None and not np.isnan(found[3]) and abs(found[3]) > o.k),
        }
