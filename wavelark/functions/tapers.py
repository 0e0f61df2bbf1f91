"""Symmetric window functions, by name, from their cosine sums or formulas."""

from __future__ import annotations

import numpy as np

#: Coefficients of the cosine-sum windows.
COSINE_SUMS = {
    "boxcar": [1.0],
    "hann": [0.5, 0.5],
    "hamming": [0.54, 0.46],
    "blackman": [0.42, 0.5, 0.08],
    "nuttall": [0.3635819, 0.4891775, 0.1365995, 0.0106411],
    "blackmanharris": [0.35875, 0.48829, 0.14128, 0.01168],
    "flattop": [0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368],
}
ALIASES = {"rectangular": "boxcar", "ones": "boxcar", "hanning": "hann", "triangle": "triang", "tri": "triang"}


def taper(name: str | tuple, size: int, periodic: bool = False) -> np.ndarray:
    """The named window; a tuple gives a name and its parameter. ``periodic`` leaves out the last point of size + 1."""
    if periodic:
        return taper(name, size + 1)[:-1]
    kind, *more = (name,) if isinstance(name, str) else tuple(name)
    kind = ALIASES.get(kind, kind)
    n = np.arange(size)
    x = 2 * n / (size - 1) - 1 if size > 1 else np.zeros(1)
    if kind in COSINE_SUMS:
        angle = 2 * np.pi * n / (size - 1) if size > 1 else np.zeros(1)
        return sum((-1) ** j * a * np.cos(j * angle) for j, a in enumerate(COSINE_SUMS[kind])) if size > 1 else np.ones(1)
    if kind == "bartlett":
        return 1 - np.abs(x)
    if kind == "triang":
        return 1 - np.abs(2 * n - (size - 1)) / (size + size % 2)
    if kind == "cosine":
        return np.sin(np.pi * (n + 0.5) / size)
    if kind == "parzen":
        y = np.abs(2 * n - (size - 1)) / size
        return np.where(y <= 0.5, 1 - 6 * y**2 * (1 - y), 2 * (1 - y) ** 3)
    if kind == "bohman":
        y = np.abs(x)
        return (1 - y) * np.cos(np.pi * y) + np.sin(np.pi * y) / np.pi
    if kind == "gaussian" and more:
        return np.exp(-0.5 * ((n - (size - 1) / 2) / more[0]) ** 2)
    if kind == "kaiser" and more:
        return np.kaiser(size, more[0])
    if kind == "tukey":
        edge = more[0] if more else 0.5
        rise = np.clip((1 - np.abs(x)) / edge, 0, 1) if edge > 0 else np.ones(size)
        return 0.5 * (1 - np.cos(np.pi * rise))
    if kind in FAMILIES:
        return FAMILIES[kind](size, *more) if size > 1 else np.ones(size)
    raise ValueError(f"unknown window {name!r}")


def checked(name: str | tuple, size: int) -> list[float]:
    values = taper(name, size)
    if not np.sum(values**2) > 0:
        raise ValueError(f"the window {name!r} of {size} samples weighs nothing; one of non-zero energy is needed")
    return values.tolist()


def slepian(size: int, half_bandwidth: float = 4.0) -> np.ndarray:
    """The first discrete prolate spheroidal sequence, scaled to a peak of 1: the leading eigenvector of the
    tridiagonal matrix that commutes with the band-limiting operator.

    It is symmetric, so a tridiagonal matrix of half the size has it. Bisection finds a bound just above the largest eigenvalue
    (a number is above all if no pivot of the shifted matrix is positive), and inverse iteration from there the vector:
    time and memory grow with the size, not with its square.
    """
    if size < 2:
        return np.ones(size)
    n = np.arange(size, dtype=float)
    diagonal = ((size - 1 - 2 * n) / 2) ** 2 * np.cos(2 * np.pi * half_bandwidth / size)
    off = n[1:] * (size - n[1:]) / 2
    half = (size + 1) // 2
    a, b = diagonal[:half].copy(), off[: half - 1].copy()
    if size % 2:
        b[-1] *= np.sqrt(2.0)  # the middle stands for itself alone
    else:
        a[-1] += off[half - 1]  # the two middles are equal
    a, squares = a.tolist(), (b**2).tolist()
    reach = np.abs(np.concatenate([[0], b])) + np.abs(np.concatenate([b, [0]]))
    low, high = max(a), float((np.array(a) + reach).max())

    def above_all(x: float) -> bool:
        d = a[0] - x
        for i, s in enumerate(squares):
            if d >= 0:
                return False
            d = a[i + 1] - x - s / d
        return d < 0

    while True:
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (low, middle) if above_all(middle) else (middle, high)
    shift = high + 4 * np.spacing(abs(high))
    vector = np.ones(half)
    for _ in range(4):
        vector = _solved(a, b.tolist(), shift, vector.tolist())
        vector /= np.abs(vector).max()
    vector = np.abs(vector)
    if size % 2:
        whole = np.concatenate([vector[:-1], [vector[-1] * np.sqrt(2.0)], vector[-2::-1]])
    else:
        whole = np.concatenate([vector, vector[::-1]])
    return whole / whole.max()


def _solved(a: list[float], b: list[float], shift: float, right: list[float]) -> np.ndarray:
    """The solution of the shifted tridiagonal system, which is negative definite: elimination needs no exchange of rows."""
    pivot, y = a[0] - shift, right[:]
    pivots = [pivot]
    for i, s in enumerate(b):
        m = s / pivot
        y[i + 1] -= m * y[i]
        pivot = a[i + 1] - shift - m * s
        pivots.append(pivot)
    x = y[-1] / pivots[-1]
    out = [x]
    for i in range(len(b) - 1, -1, -1):
        x = (y[i] - b[i] * x) / pivots[i]
        out.append(x)
    return np.array(out[::-1])


def chebyshev(size: int, attenuation: float) -> np.ndarray:
    """Dolph's window: its spectrum is a Chebyshev polynomial, so all side lobes lie ``attenuation`` dB below the main one."""
    order = size - 1
    widest = np.cosh(np.arccosh(10 ** (abs(attenuation) / 20)) / order)
    k = np.arange(size // 2 + 1)
    x = widest * np.cos(np.pi * k / size)
    inside = np.abs(x) <= 1
    value = np.where(inside, np.cos(order * np.arccos(np.clip(x, -1, 1))), np.cosh(order * np.arccosh(np.maximum(np.abs(x), 1))) * np.where(x < 0, (-1.0) ** order, 1.0))
    w = np.fft.irfft(value * np.exp(-1j * np.pi * k * order / size), size)
    return w / w.max()


def taylor(size: int, near: int = 4, level: float = 30.0, norm: bool = True) -> np.ndarray:
    """Taylor's window: the ``near`` first side lobes lie about ``level`` dB below the main one. Its coefficients follow from
    the nulls of its pattern, which meet those of the uniform window at ``near``."""
    a = np.arccosh(10 ** (abs(level) / 20)) / np.pi
    i = np.arange(1, near, dtype=float)
    nulls = near**2 / (a**2 + (near - 0.5) ** 2) * (a**2 + (i - 0.5) ** 2)
    weights = [(-1) ** (m + 1) * np.prod(1 - m**2 / nulls) / (2 * np.prod(1 - m**2 / i[i != m] ** 2)) for m in range(1, near)]
    at = lambda n: 1 + 2 * sum(f * np.cos(2 * np.pi * m * (n - (size - 1) / 2) / size) for m, f in enumerate(weights, 1))
    w = at(np.arange(size)) * np.ones(size)
    return w / at((size - 1) / 2) if norm else w


def dpss(size: int, half_bandwidth: float) -> np.ndarray:
    """The Slepian sequence by name; for an even size its peak lies between two points, and the usual approximation of it is 1."""
    w = slepian(size, half_bandwidth)
    return w if size % 2 else w * size**2 / (size**2 + half_bandwidth)


def cosine_sum(size: int, coefficients) -> np.ndarray:
    angle = np.linspace(-np.pi, np.pi, size)
    return sum(a * np.cos(k * angle) for k, a in enumerate(coefficients))


def exponential(size: int, center: float | None = None, tau: float = 1.0) -> np.ndarray:
    if center is not None:
        raise ValueError("a symmetric exponential window has its center in the middle")
    return np.exp(-np.abs(np.arange(size) - (size - 1) / 2) / tau)


def _barthann(size: int) -> np.ndarray:
    y = np.abs(np.arange(size) / (size - 1) - 0.5)
    return 0.62 - 0.48 * y + 0.38 * np.cos(2 * np.pi * y)


#: Further families: a function of the size and the parameters of the name.
FAMILIES = {
    "chebwin": chebyshev,
    "taylor": taylor,
    "dpss": dpss,
    "exponential": exponential,
    "general_cosine": cosine_sum,
    "general_hamming": lambda size, alpha: cosine_sum(size, [alpha, 1 - alpha]),
    "general_gaussian": lambda size, power, sigma: np.exp(-0.5 * np.abs((np.arange(size) - (size - 1) / 2) / sigma) ** (2 * power)),
    "barthann": _barthann,
    "lanczos": lambda size: np.sinc(2 * np.arange(size) / (size - 1) - 1),
}
ALIASES |= {"cheb": "chebwin", "taylorwin": "taylor", "poisson": "exponential", "brthan": "barthann", "bth": "barthann", "sinc": "lanczos"}
