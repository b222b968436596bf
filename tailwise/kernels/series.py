"""Kernels for one series or one target in memory: mode, neighbour weights, recursive forecasts, bootstrap."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from tailwise.kernels.stats import order_stat

#: The triangular smoother of bin counts.
TRIANGLE = np.array([1, 2, 3, 4, 3, 2, 1]) / 16


def half_up(x):
    return np.floor(np.asarray(x, float) + 0.5)


def mode(x: np.ndarray, discrete: bool = False, multi: bool = False):
    """Modal value, or all of them with multi. Continuous data are binned by quartile width and smoothed; a peak
    tops three bins on either side, and of peaks within three bins the highest stays."""
    s = np.sort(x[np.isfinite(x)])
    n = len(s)
    if n == 0:
        return np.array([np.nan]) if multi else math.nan
    if n <= 3:
        return float(half_up(np.median(s))) if discrete else float(np.median(s))
    if discrete:
        value, count = np.unique(half_up(s), return_counts=True)
        top = value[count == count.max()]
        return top if multi else float(top.mean())
    if s[0] == s[-1]:
        return float(s[0])
    lo, hi = ([order_stat(s, n * q, up) for q in (0.25, 0.75)] for up in (False, True))
    q1, q3 = lo if n % 2 == 0 else [a + (n * q % 1) * (b - a) for a, b, q in zip(lo, hi, (0.25, 0.75), strict=True)]
    width = (q3 - q1) / math.sqrt(n)
    width = width if width > 0 else (s[-1] - s[0]) / 128
    bins = min(max(1, math.floor((s[-1] - s[0]) / width + 1e-12) + 1), 4 * n)
    count = np.bincount(np.clip(((s - s[0]) // width).astype(np.int64), 0, bins - 1), minlength=bins)
    name = s[0] + np.arange(bins) * width
    centre = lambda k, r: float(name[max(0, k - r) : k + r + 1] @ count[max(0, k - r) : k + r + 1] / max(1, count[max(0, k - r) : k + r + 1].sum()))
    smooth = np.convolve(np.pad(count, 3, mode="reflect"), TRIANGLE, "valid") if bins > 3 else count.astype(float)
    peaks = [k for k in range(3, bins - 3) if smooth[k] > 0 and smooth[k] > max(*smooth[k - 3 : k], *smooth[k + 1 : k + 4])]
    kept: list[int] = []
    for k in sorted(peaks, key=lambda k: -smooth[k]):
        if all(abs(k - j) > 3 for j in kept):
            kept.append(k)
    if kept:
        return np.sort([centre(k, 3) for k in kept]) if multi else centre(kept[0], 3)
    top = np.flatnonzero(count == count.max())
    out = name[top] if len(top) > 1 else np.array([centre(int(top[0]), 1)])
    return out if multi else float(out.mean())


def _shares(w: np.ndarray) -> np.ndarray:
    total = w.sum()
    return w / total if np.isfinite(total) and total > 0 else np.zeros_like(w)


def neighbour_weights(d: np.ndarray, population: bool = False) -> np.ndarray:
    """Mean of eight families of weights for neighbours at ascending distances d: even, Student, inverse,
    exponential, log-normal, power, normal, radial. Constants that cancel are left out."""
    k, rank = len(d), np.arange(1, len(d) + 1.0)
    out = np.full(k, 1 / k) + _shares((1 + d * d / k) ** (-(k + 1) / 2)) + _shares(1 / d) + _shares(np.exp(-k * rank)) + _shares(rank**-2)
    if k > 1:
        sd = math.sqrt((k * k - 1) / 12) if population else float(np.std(rank, ddof=1))
        log = -np.log(rank * sd * math.sqrt(2 * math.pi)) - np.log(rank) ** 2 / (2 * sd * sd)
        out = out + _shares(np.abs(log)[::-1])
        var = float(np.var(d, ddof=1))
        if var > 0:
            out = out + _shares(np.exp(-d * d / (2 * var))) + _shares(np.exp(-d / (2 * var)))
    return _shares(out)


def nearest(features: np.ndarray, y: np.ndarray, target: np.ndarray, k: int | None = None, classes: bool = False) -> float:
    """Prediction at target from its k nearest rows after scaling rows and target together to 0..1."""
    lo, hi = np.minimum(features.min(axis=0), target), np.maximum(features.max(axis=0), target)
    span = np.where(hi > lo, hi - lo, 1.0)
    diff = np.abs(features - target) / span
    d = (diff * diff + diff).sum(axis=1)
    d[d == 0] = 1e-10
    own = np.argsort(d, kind="stable")[: k or len(d)]
    if len(own) == 1:
        return float(y[own[0]])
    w = neighbour_weights(d[own])
    if classes:
        value, place = np.unique(y[own], return_inverse=True)
        return float(value[np.argmax(np.bincount(place, weights=np.ceil(100 * w)))])
    return float(y[own] @ w)


def line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope; a constant x gives the mean and 0."""
    a = x - x.mean()
    s = float(a @ a)
    slope = float(a @ (y - y.mean())) / s if s else 0.0
    return float(y.mean()) - slope * float(x.mean()), slope


def lag_weights(x: np.ndarray, lags: list[int]) -> np.ndarray:
    """Weights of explicit lags: how much less their subsequence varies, over the root of the lag."""
    cv = lambda v: abs(float(np.std(v, ddof=1)) / float(np.mean(v))) if len(v) > 1 and np.mean(v) else math.inf
    rel = np.array([max(cv(x[::-lag]) / cv(x), np.finfo(float).eps) for lag in lags])
    return _shares(1 / rel / np.sqrt(np.array(lags, float)))


def forecast(x: np.ndarray, h: int, lags: list[int], method: str = "lin", weights: np.ndarray | None = None, negative: bool | None = None, shrink: bool = False) -> np.ndarray:
    """Recursive forecasts of h steps: each lag's subsequence is carried on by its line ('lin') or its mean
    ('means'), lags are averaged by weight, and the estimate joins the series."""
    negative = bool(x.min() < 0) if negative is None else negative
    w = lag_weights(x, lags) if weights is None else np.asarray(weights, float)
    buffer = np.concatenate([x, np.zeros(h)])
    for t in range(len(x), len(x) + h):
        own = []
        for lag in lags:
            part = buffer[t % lag : t : lag]
            at = np.arange(1, len(part) + 1.0)
            a, b = line(at, part)
            mean = float(part.mean())
            value = mean if method == "means" else a + b * (len(part) + 1)
            own.append((value + mean) / 2 if shrink and method != "means" else value)
        value = float(np.array(own) @ w)
        buffer[t] = value if negative else max(0.0, value)
    return buffer[len(x) :]


def _ranks(x: np.ndarray) -> np.ndarray:
    value, place, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[place]


def _corr(a: np.ndarray, b: np.ndarray, kind: str) -> float:
    if kind == "spearman":
        a, b = _ranks(a), _ranks(b)
    a, b = a - a.mean(), b - b.mean()
    s = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / s if s else math.nan


def _least(f, lo: float = 0.0, hi: float = 1.0, near: float = 0.01) -> float:
    """Place of a minimum by golden sections."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > near:
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def maximum_entropy_bootstrap(x: np.ndarray, reps: int, rho: float = 1.0, kind: str = "spearman", drift: bool = True, trim: float = 0.1, clt: bool = True, digits: int = 6, seed: int = 0) -> np.ndarray:
    """Replicates (rows: time) of x: residuals around its line are drawn from the maximum-entropy density of
    their order statistics, put back in order, blended with their reverse towards the rank correlation rho, spread
    like the residuals, and, with clt, centred like means of samples."""
    n, rng = len(x), np.random.default_rng(seed)
    time = np.arange(1, n + 1.0)
    a, b = line(time, x)
    rest = x - (a + b * time)
    s, order = np.sort(rest), np.argsort(rest, kind="stable")
    z = (s[1:] + s[:-1]) / 2
    jumps = np.sort(np.abs(np.diff(rest)))
    cut = int(trim * len(jumps))
    tail = float(jumps[cut : len(jumps) - cut].mean())
    p = rng.random((n, reps))
    at = 1 + (n - 1) * p
    j = np.clip(np.floor(at).astype(int), 1, n - 1)
    q = (1 - (at - np.floor(at))) * s[j - 1] + (at - np.floor(at)) * s[j]
    q = np.where(p <= 1 / n, s[0] - tail + p * n * (z[0] - (s[0] - tail)), q)
    q = np.where(p >= (n - 1) / n, z[-1] + (p - (n - 1) / n) * n * (s[-1] + tail - z[-1]), q)
    draws = np.empty_like(q)
    draws[order] = np.sort(q, axis=0)
    r = _ranks(rest)
    up, down = (np.clip(np.floor(v).astype(int) - 1, 0, n - 1) for v in (r, r.max() + 1 - r))
    for k in range(reps):
        own = np.sort(draws[:, k])
        t = _least(lambda t, e=own[up], m=own[down]: abs(_corr(t * m + (1 - t) * e, rest, kind) - rho))
        draws[:, k] = t * own[down] + (1 - t) * own[up]

    def spread(m: np.ndarray, like: np.ndarray) -> np.ndarray:
        sd, want = m.std(axis=0, ddof=1), float(like.std(ddof=1))
        ratio = sd / want
        factor = want / sd * np.where(ratio < 1, rng.uniform(1, 1.05, reps), ratio)
        return m * np.where(factor >= 1, factor, 1.0)

    out = spread(spread(draws, rest) + (a + (b if drift else 0.0) * time)[:, None], x)
    if clt and reps > 1:
        se = float(x.std(ddof=1)) / math.sqrt(reps)
        target = np.array([NormalDist().inv_cdf(k / (reps + 1)) for k in range(1, reps + 1)])
        target = (target - target.mean()) / target.std(ddof=1) * se + x.mean()
        means = out.mean(axis=0)
        place = np.argsort(means, kind="stable")
        out[:, place] += target - means[place]
    return np.round(out, digits)


def rho_grid(low: float = -1.0, high: float = 1.0, by: float = 0.01, exponent: float = 1.0) -> np.ndarray:
    """Rank correlations from high to low, denser near 0 or 1 by the exponent."""
    grid = low + by * np.arange(math.floor((high - low) / by + 1e-12) + 1)
    return np.concatenate([-(np.abs(grid[grid <= 0]) ** exponent), grid[grid > 0] ** (1 / exponent)])[::-1]
