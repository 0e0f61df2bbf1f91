"""Median and median absolute deviation of a history that slides, from values kept in order."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable

#: Values that a block holds before it is divided.
LOAD = 256


class Ordered:
    """Numbers in order, as blocks of bounded size: adding, removing and taking the n-th touch one block and the blocks' sizes."""

    def __init__(self) -> None:
        self.blocks: list[list[float]] = []
        self.tops: list[float] = []
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def add(self, x: float) -> None:
        self.size += 1
        if not self.blocks:
            self.blocks.append([x])
            self.tops.append(x)
            return
        i = min(bisect_left(self.tops, x), len(self.blocks) - 1)
        block = self.blocks[i]
        insort(block, x)
        self.tops[i] = block[-1]
        if len(block) > LOAD:
            half = len(block) // 2
            self.blocks[i : i + 1] = [block[:half], block[half:]]
            self.tops[i : i + 1] = [block[half - 1], block[-1]]

    def remove(self, x: float) -> None:
        i = bisect_left(self.tops, x)
        block = self.blocks[i]
        del block[bisect_left(block, x)]
        self.size -= 1
        if block:
            self.tops[i] = block[-1]
        else:
            del self.blocks[i], self.tops[i]

    def at(self, n: int) -> float:
        for block in self.blocks:
            if n < len(block):
                return block[n]
            n -= len(block)
        raise IndexError(n)

    def below(self, x: float) -> int:
        """How many are less than ``x``."""
        i = bisect_left(self.tops, x)
        return sum(map(len, self.blocks[:i])) + (bisect_left(self.blocks[i], x) if i < len(self.blocks) else 0)

    def median(self) -> float:
        return (self.at((self.size - 1) // 2) + self.at(self.size // 2)) / 2

    def distance(self, n: int, centre: float, split: int) -> float:
        """The n-th least distance to ``centre``; ``split`` values are below it.

        Distances to both sides are in order already: a search by halves tells how many of the n are from below.
        """
        low, high = max(0, n - (self.size - split)), min(n, split)  # from below, among the n before the wanted one
        while low < high:
            take = (low + high) // 2
            # the next from below against the last taken from above
            if centre - self.at(split - 1 - take) < self.at(split + n - take - 1) - centre:
                low = take + 1
            else:
                high = take
        below = centre - self.at(split - 1 - low) if low < split else math.inf
        above = self.at(split + n - low) - centre if split + n - low < self.size else math.inf
        return min(below, above)


class SlidingSpread:
    """The last ``size`` numbers: their median, and the median of their distances to it."""

    def __init__(self, size: int, values: Iterable[float] = ()) -> None:
        self.size, self.values, self.ordered, self.undefined = size, deque(), Ordered(), 0
        for x in values:
            self.append(x)

    def __len__(self) -> int:
        return len(self.values)

    def append(self, x: float) -> None:
        self.values.append(x)
        if math.isnan(x):
            self.undefined += 1
        else:
            self.ordered.add(x)
        if len(self.values) > self.size:
            old = self.values.popleft()
            if math.isnan(old):
                self.undefined -= 1
            else:
                self.ordered.remove(old)

    def spread(self) -> tuple[float, float]:
        """Median and median absolute deviation; not numbers where a value is none, the second also around infinity."""
        if self.undefined:
            return math.nan, math.nan
        centre = self.ordered.median()
        if not math.isfinite(centre):
            return centre, math.nan
        n, split = len(self.ordered), self.ordered.below(centre)
        middle = self.ordered.distance((n - 1) // 2, centre, split)
        return centre, (middle if n % 2 else (middle + self.ordered.distance(n // 2, centre, split)) / 2)
