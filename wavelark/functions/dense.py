"""All windows of a block at once: what densely overlapping windows share is computed once, in NumPy.

A taper that is a sum of cosines turns energies into sums, over each window, of samples and of their squares times few
cosines. A sum over a window is the end of one stretch of the window's length plus the beginning of the next one, so every
sum is made of additions only and nothing cancels; the work for a sample does not depend on the length of the windows.
"""

from __future__ import annotations

import numpy as np

from .tapers import ALIASES, COSINE_SUMS


def cosine_coefficients(name: str | tuple) -> list[float] | None:
    """Coefficients a_k of a taper sum(a_k cos(k x)), x from 0 to 2 pi over the window; None if it is no such sum."""
    kind, *more = (name,) if isinstance(name, str) else tuple(name)
    kind = ALIASES.get(kind, kind)
    if kind in COSINE_SUMS:
        return [(-1) ** k * a for k, a in enumerate(COSINE_SUMS[kind])]
    if kind == "general_hamming" and more:
        return [more[0], more[0] - 1]
    return [(-1) ** k * a for k, a in enumerate(more[0])] if kind == "general_cosine" and more else None


def squared(coefficients: list[float]) -> np.ndarray:
    """Coefficients of the square of a sum of cosines."""
    out = np.zeros(2 * len(coefficients) - 1)
    for i, a in enumerate(coefficients):
        for j, b in enumerate(coefficients):
            out[i + j] += a * b / 2
            out[abs(i - j)] += a * b / 2
    return out


#: How much larger than an energy the terms may be that it is made of: what is lost is about this times 1e-16.
LARGEST = 1e5


class Stretches:
    """Values cut into stretches of a window's length: a window is the end of one and the beginning of the next."""

    def __init__(self, count: int, size: int, starts: np.ndarray) -> None:
        self.size, self.rows = size, -(-count // size) + 1
        self.row, self.at = np.divmod(starts, size)

    def cut(self, values: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.rows * self.size, values.dtype)
        padded[: len(values)] = values
        return padded.reshape(self.rows, self.size)

    def parts(self, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, the sums of its part in the first and in the second stretch."""
        ahead, behind = np.cumsum(stretches, axis=1), np.cumsum(stretches[:, ::-1], axis=1)[:, ::-1]
        return behind[self.row, self.at], np.where(self.at > 0, ahead[self.row + 1, np.maximum(self.at - 1, 0)], 0)


def window_sums(values: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """The sum of ``size`` values from each start on."""
    own = Stretches(len(values), size, starts)
    first, second = own.parts(own.cut(values))
    return first + second


def energies(signal: np.ndarray, size: int, starts: np.ndarray, coefficients: list[float]) -> np.ndarray:
    """Energies of the centred and tapered windows; those with a value that is no number are no numbers.

    Each stretch is measured from a level of its own, as a constant is no energy, so the sums stay as small as the signal moves.
    """
    own = Stretches(len(signal), size, starts)
    finite = own.cut(np.isfinite(signal))
    x = own.cut(np.where(np.isfinite(signal), signal, 0.0))
    level = x.sum(axis=1) / np.maximum(finite.sum(axis=1), 1)
    x = np.where(finite, x - level[:, None], 0.0)
    angle = 2 * np.pi / (size - 1)
    n = np.arange(x.size).reshape(x.shape)
    tapered, squares, w2 = [np.zeros(len(starts)) for _ in "ab"], [np.zeros(len(starts)) for _ in "ab"], np.zeros(size)
    for k, c in enumerate(squared(coefficients)):
        turn, back = np.exp(1j * angle * k * n), np.exp(-1j * angle * k * starts)
        for sums, values in ((tapered, x * turn), (squares, x * x * turn)):
            for i, part in enumerate(own.parts(values)):
                sums[i] += c * (part * back).real
        w2 += c * np.cos(angle * k * np.arange(size))
    first, second = own.parts(x)
    weight = np.concatenate([[0.0], np.cumsum(w2)])[size - own.at]
    jump = level[np.minimum(own.row + 1, own.rows - 1)] - level[own.row]
    mean = (first + second + jump * own.at) / size  # from the first stretch's level
    beyond = jump - mean
    out = squares[0] - 2 * mean * tapered[0] + mean**2 * weight + squares[1] + 2 * beyond * tapered[1] + beyond**2 * (w2.sum() - weight)
    lost = window_sums((~np.isfinite(signal)).astype(np.int64), size, starts) > 0
    # What a window is the small difference of, as beside a jump, is added up sample by sample.
    largest = sum(own.parts(x * x)) + size * (mean**2 + beyond**2)
    fine = np.flatnonzero(~lost & (largest > LARGEST * out))
    for some in np.array_split(fine, max(1, len(fine) * size // (1 << 22))):
        windows = np.lib.stride_tricks.sliding_window_view(signal, size)[starts[some]]
        out[some] = ((windows - windows.mean(axis=1, keepdims=True)) ** 2) @ w2
    return np.where(lost, np.nan, np.maximum(out, 0.0) / w2.sum())


def longest_runs(missing: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """The longest run of missing samples of each window, runs over its ends counting with their part in it."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], missing.astype(np.int8), [0]])))
    first, stop = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(len(starts), np.int64)
    # Whole runs within a window follow one another: the longest of a range, from tables of powers of two.
    table = [stop - first]
    while 2 ** len(table) <= len(first):
        half = 2 ** (len(table) - 1)
        table.append(np.maximum(table[-1][:-half], table[-1][half:]))
    ends = starts + size
    i, j = np.searchsorted(first, starts, "left"), np.searchsorted(stop, ends, "right")
    best = np.zeros(len(starts), np.int64)
    count = np.maximum(j - i, 0)
    for level, row in enumerate(table):
        own = (count >= 2**level) & (count < 2 ** (level + 1))
        best[own] = np.maximum(row[i[own]], row[j[own] - 2**level])
    for run in (i - 1, j):  # a run over the start, and one over the end; it may be the same
        there = (run >= 0) & (run < len(first))
        at = np.clip(run, 0, len(first) - 1)
        part = np.minimum(stop[at], ends) - np.maximum(first[at], starts)
        best = np.maximum(best, np.where(there, np.maximum(part, 0), 0))
    return best
