"""Piecewise regression of one group: breakpoints from the partition, segments between them, forecasts."""

from __future__ import annotations

import math

import numpy as np

from tailwise.kernels.series import line, mode
from tailwise.kernels.stats import dependence, gravity, partition


def copula(m: np.ndarray) -> float:
    """Dependence in 0..1 of the columns of m around their means."""
    d = m.shape[1]
    a = m - m.mean(axis=0)
    co0 = co1 = 0.0
    for i in range(d):
        for j in range(i + 1, d):
            p = a[:, i] * a[:, j]
            total = float(np.abs(p).sum())
            co0 += float(np.mean((a[:, i] > 0) == (a[:, j] > 0)))
            co1 += float(p[p > 0].sum()) / total if total else 0.0
    if co0 in (0.0, 1.0):
        return 1.0
    product = np.abs(np.prod(a, axis=1))
    apart = ~((a < 0).all(axis=1) | (a > 0).all(axis=1))
    # Rows with a tie at the mean count as discordant and, if otherwise on one side, as concordant too.
    sides = product[(a <= 0).all(axis=1)].sum() + product[(a >= 0).all(axis=1)].sum()
    d1 = float(product[apart].sum())
    d1 = d1 / (d1 + sides) if d1 + sides else 0.0
    free, free_d = 0.25 * (d * d - d), 1 - 0.5**d
    terms = (min(abs(co0 - free) / free, 1), min(abs(co1 - free) / free, 1), abs(float(apart.mean()) - free_d) / free_d, abs(d1 - free_d) / free_d)
    return math.sqrt(sum(terms) / 4)


def unit(v: np.ndarray) -> np.ndarray:
    return (v - v.min()) / np.ptp(v) if np.ptp(v) else np.zeros(len(v))


def strength(x: np.ndarray, y: np.ndarray) -> float:
    """Mean of the asymmetric dependence and the copula of (x, x, y); decides the depth of the partition."""
    out = (dependence(x, y, True)[1] + copula(np.stack([unit(x), unit(x), unit(y)], axis=1))) / 2
    return out if math.isfinite(out) else 0.1


def merged(x, y) -> tuple[np.ndarray, np.ndarray]:
    """One point per x, at the gravity of its ys."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    ok = np.isfinite(x) & np.isfinite(y)
    value, place = np.unique(x[ok], return_inverse=True)
    return value, np.array([gravity(y[ok][place == k]) for k in range(len(value))])


def _edge(x: np.ndarray, y: np.ndarray, reach: float, low: bool, dep: float, classes: bool) -> float:
    """y at an end of the data: lines through all data beyond the outermost breakpoint, and through the outer half
    of them, by their sizes."""
    end = float(x.min() if low else x.max())
    side = lambda r: x <= r if low else x >= r
    outer, half = side(reach), side((end + reach) / 2)
    if classes:
        return float(mode(y[outer], discrete=True))
    if len(np.unique(x[half])) > 1 and outer.sum() > 5:
        if dep < 0.95:
            fits = [(int(own.sum()), *line(x[own], y[own])) for own in (outer, half)]
            return sum(n * (a + b * end) for n, a, b in fits) / sum(n for n, _, _ in fits)
        return float(np.unique(y[x == end]).mean())
    return gravity(y[x == end])


def breakpoints(x: np.ndarray, y: np.ndarray, order: int | None = None, centre: str = "off", classes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Points that the regression passes through: centres of the cells of x, a central point, and the ends."""
    dep = strength(x, y)
    depth = max(1, int(math.floor(order + 0.5))) if order is not None else max(1, math.floor(dep * 10) // (2 if len(x) < 100 else 1))
    if dep == 1.0:
        found = partition(x, y, order=1 if order is None else depth, least=0)[3]
    else:
        found = partition(x, y, True, depth, 0, True, centre)[3]
    px, py = merged(np.clip([p[1] for p in found], x.min(), x.max()), [p[2] for p in found])
    middle = None
    if not classes:
        lo, hi = (len(px) - 1) // 2, len(px) // 2
        own = (x >= px[lo]) & (x <= px[hi])
        middle = (gravity(px[[lo, hi]]), gravity(y[own]) if lo != hi else float(py[lo]))
        px, py = merged([*px, middle[0]], [*py, middle[1]])
    if dep >= 1.0 and not classes:
        ends = float(y[np.argmin(x)]), float(y[np.argmax(x)])
    else:
        ends = tuple(_edge(x, y, float(px.min() if low else px.max()), low, dep, classes) for low in (True, False))
    # The central point counts once more here.
    more = [] if middle is None else [middle]
    px, py = merged([*px, x.min(), x.max(), *(m[0] for m in more)], [*py, *ends, *(m[1] for m in more)])
    py = np.clip(py, y.min(), y.max())
    return px, np.clip(np.floor(py + 0.5), y.min(), y.max()) if classes else py


def segments(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Rows (from, at_x, at_y, slope), ascending: from -inf and beyond the data the mean of the two outermost
    distinct slopes goes on from the observed end."""
    slope = np.diff(py) / np.diff(px) if len(px) > 1 else np.zeros(1)
    slope = np.where(np.isposinf(slope), 1.0, np.where(np.isfinite(slope), slope, 0.0))
    distinct = list(dict.fromkeys(slope.tolist()))
    out = [(-math.inf, float(x.min()), float(y[np.argmin(x)]), float(np.mean(distinct[:2])))]
    out += [(float(a), float(a), float(b), float(slope[min(k, len(slope) - 1)])) for k, (a, b) in enumerate(zip(px, py, strict=True))]
    return [*out, (math.nextafter(float(x.max()), math.inf), float(x.max()), float(y[np.argmax(x)]), float(np.mean(distinct[-2:])))]


def predict(rows: list[tuple[float, float, float, float]], at: np.ndarray) -> np.ndarray:
    t = np.array(rows)
    own = t[np.searchsorted(t[:, 0], at, side="right") - 1]
    return own[:, 2] + (at - own[:, 1]) * own[:, 3]


def next_value(part: np.ndarray) -> float:
    """The value after a subsequence: its last plus the slope from all breakpoints to the last one, later ones
    weighing more."""
    if len(part) < 2:
        return float(part[-1])
    px, py = breakpoints(np.arange(1, len(part) + 1.0), part)
    w = np.arange(1, len(px)) ** 2
    run = float((px[-1] - px[:-1]) @ w) if len(px) > 1 else 0.0
    return float(part[-1]) + (float((py[-1] - py[:-1]) @ w) / run if run else 0.0)


def forecast_nonlinear(x: np.ndarray, h: int, lags: list[int], weights: np.ndarray, negative: bool = False, both: bool = False, shrink: bool = False) -> np.ndarray:
    """Recursive forecasts, below 0 only if negative; with both each step is the mean of this and the linear one."""
    buffer = np.concatenate([x, np.zeros(h)])
    floor = -math.inf if negative else 0.0
    for t in range(len(x), len(x) + h):
        parts = [buffer[t % lag : t : lag] for lag in lags]
        own = np.array([next_value(p) for p in parts])
        if shrink:
            own = (own + [p.mean() for p in parts]) / 2
        value = float(np.maximum(floor, own) @ weights)
        if both:
            fits = [(len(p), float(p.mean()), *line(np.arange(1, len(p) + 1.0), p)) for p in parts]
            flat = np.array([((a + b * (n + 1)) + m) / 2 if shrink else a + b * (n + 1) for n, m, a, b in fits])
            value = (value + max(floor, float(flat @ weights))) / 2
        buffer[t] = value
    return buffer[len(x) :]
