"""Kernels for one group in memory: gravity, signed copula, dependence, causation, partition, regression."""

from __future__ import annotations

import math

import numpy as np


def order_stat(s: np.ndarray, place: float, up: bool) -> float:
    k = math.ceil(place) if up else math.floor(place)
    return float(s[min(max(k, 1), len(s)) - 1])


def gravity(x: np.ndarray, discrete: bool = False) -> float:
    s = np.sort(x[np.isfinite(x)])
    n = len(s)
    if not n:
        return math.nan
    if n <= 3 or s[0] == s[-1]:
        out = float(np.median(s)) if n <= 3 else float(s[0])
        return math.floor(out + 0.5) if discrete and n <= 3 else out
    lo, hi = ([order_stat(s, n * q, up) for q in (0.25, 0.5, 0.75)] for up in (False, True))
    if n % 2 == 0:
        q1, q2, q3 = lo
    else:
        q1, q3 = (lo[k] + (n * q % 1) * (hi[k] - lo[k]) for k, q in ((0, 0.25), (2, 0.75)))
        q2 = (lo[1] + hi[1]) / 2
    width = (q3 - q1) / math.sqrt(n)
    if not width > 0:
        width = (s[-1] - s[0]) / 128
    bins = min(max(1, math.floor((s[-1] - s[0]) / width + 1e-12) + 1), 4 * n)
    count = np.bincount(np.clip(((s - s[0]) // width).astype(np.int64), 0, bins - 1), minlength=bins)
    name = s[0] + np.arange(bins) * width
    top = np.flatnonzero(count == count.max())
    own = slice(max(0, top[0] - 1), top[0] + 2) if len(top) == 1 else slice(None)
    modal = float(name[own] @ count[own] / count[own].sum())
    out = (q2 + modal + float(s.mean()) + (q1 + q3) / 2) / 4
    return math.floor(out + 0.5) if discrete else out


def gravities(v: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The gravity of each run of v that begins at one of start: finite values, ascending in a run, n times each."""
    runs = np.arange(len(start))
    of = np.repeat(runs, np.diff(np.r_[start, len(v)]))
    total = np.add.reduceat(n, start)
    upto = np.cumsum(n)
    before = (upto - n)[start]
    low, high = v[start], v[np.r_[start[1:], len(v)] - 1]
    at = lambda k: v[np.searchsorted(upto, before + k)]  # noqa: E731  the least value with k rows up to it
    new = np.r_[True, (v[1:] != v[:-1]) | (of[1:] != of[:-1])]  # distinct values, around whose mean rows are added up
    centre = np.add.reduceat(np.where(new, v, 0.0), start) / np.add.reduceat(new.astype(np.int64), start)
    mean = centre + np.add.reduceat(n * (v - centre[of]), start) / total
    down, up = {}, {}
    for q in (0.25, 0.5, 0.75):
        down[q], up[q] = at(np.maximum(1, np.floor(total * q).astype(np.int64))), at(np.clip(np.ceil(total * q).astype(np.int64), 1, total))
    even = total % 2 == 0
    part = lambda q: np.where(even, down[q], down[q] + (total * q - np.floor(total * q)) * (up[q] - down[q]))
    q1, q2, q3 = part(0.25), np.where(even, down[0.5], (down[0.5] + up[0.5]) / 2), part(0.75)
    width = (q3 - q1) / np.sqrt(total)
    width = np.where(width > 0, width, (high - low) / 128)
    with np.errstate(divide="ignore", invalid="ignore"):
        bins = np.where(width > 0, np.floor((high - low) / width + 1e-12) + 1, 1)
        place = np.where(width[of] > 0, np.floor((v - low[of]) / width[of]), 0)
    place = np.clip(place, 0, np.minimum(np.maximum(bins, 1), 4 * total)[of] - 1)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (of[1:] != of[:-1])])  # bins ascend in a run
    count, bin_, run = np.add.reduceat(n, first), place[first], of[first]
    begin = np.searchsorted(run, runs)
    top = np.maximum.reduceat(count, begin)
    most = count == top[run]
    ties, mode_bin = np.add.reduceat(most.astype(np.int64), begin), np.maximum.reduceat(np.where(most, bin_, -1.0), begin)
    counted = np.where((ties[run] > 1) | (np.abs(bin_ - mode_bin[run]) <= 1), count, 0)
    modal = np.add.reduceat((low[run] + bin_ * width[run]) * counted, begin) / np.add.reduceat(counted, begin)
    out = 0.25 * (q2 + modal + mean + 0.5 * (q1 + q3))
    out = np.where(total <= 3, np.where(total == 2, (low + high) / 2, up[0.5]), out)
    return np.where(low == high, low, out)


def levels(x: np.ndarray, y: np.ndarray, times: np.ndarray, depth: int, least: int, stop: bool) -> tuple[np.ndarray, int]:
    """The digits of each row (x and y, so many times) as its cell is split at gravities level by level, at most depth, while it
    has more than least rows, and the last level; with stop that is the first after which a cell has least rows or fewer."""
    digits, cell = np.zeros((len(x), max(1, depth)), np.uint8), np.zeros(len(x), np.int64)
    sorted_ = [np.argsort(v, kind="stable") for v in (x, y)]
    level = 0
    while level < depth:
        size = np.bincount(cell, weights=times)
        if stop and level and size.min() <= least:
            break
        centre = []
        for v, by in zip((x, y), sorted_, strict=True):
            own = by[np.isfinite(v[by]) & (size[cell[by]] > least)]
            own = own[np.argsort(cell[own], kind="stable")]
            c, at = cell[own], np.full(len(size), np.nan)
            if len(own):
                start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                at[c[start]] = gravities(v[own], times[own], start)
            centre.append(at[cell])
        ready = ~(np.isnan(centre[0]) | np.isnan(centre[1]))
        if not ready.any():
            return _words(digits), depth
        digit = 1 + (x <= centre[0]) + 2 * (y <= centre[1])
        digits[ready, level] = 48 + digit[ready]
        cell = np.unique(cell * 5 + np.where(ready, digit, 0), return_inverse=True)[1]
        level += 1
    return _words(digits), level


def _words(digits: np.ndarray) -> np.ndarray:
    return digits.view(f"S{digits.shape[1]}")[:, 0].astype(str)


def _co_moments(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Concordant share of degree 0 and 1, discordant share of degree 0 and 1, around the means."""
    a, b = x - x.mean(), y - y.mean()
    co0 = float(np.mean((a > 0) & (b > 0)) + np.mean((a <= 0) & (b <= 0)))
    p = a * b
    total = float(np.abs(p).sum())
    co1 = float(p[p > 0].sum()) / total if total else 0.0
    apart = ~(((a < 0) & (b < 0)) | ((a > 0) & (b > 0)))
    d1 = float(np.abs(p[apart]).sum())
    return co0, co1, float(apart.mean()), d1 / total if total else 0.0


def signed_copula(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) < 2:
        return 0.0
    co0, co1, d0, d1 = _co_moments(x, y)
    if co0 in (0.0, 1.0):
        return 1.0
    size = math.sqrt((min(abs(co0 - 0.5) * 2, 1) + min(abs(co1 - 0.5) * 2, 1) + abs(d0 - 0.75) / 0.75 + abs(d1 - 0.75) / 0.75) / 4)
    slope = float(((x - x.mean()) * (y - y.mean())).sum())
    return size * float(np.sign(slope))


def cells_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their cells, where each cell starts there, its size, and its code."""
    order = np.argsort(code, kind="stable")
    own = code[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return order, start, np.diff(np.r_[start, len(own)]), own[start]


def x_cells(x: np.ndarray, least: int) -> np.ndarray:
    """Cells of x, split at their gravity while they have more than least members."""
    cell, depth = np.zeros(len(x), np.int64), math.floor(math.log2(max(1, len(x))))
    for _ in range(depth):
        order, start, count, _ = cells_of(cell)
        big = np.flatnonzero(count > least)
        if not len(big):
            break
        cell = cell * 3
        for k in big:
            own = order[start[k] : start[k] + count[k]]
            cell[own] += 1 + (x[own] > gravity(x[own]))
    return cell


def _directional(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    cell = x_cells(x, max(8, len(x) // 8))
    corr = dep = 0.0
    for c in np.unique(cell):
        own = cell == c
        v = signed_copula(x[own], y[own])
        corr += v * own.mean()
        dep += abs(v) * own.mean()
    return corr, dep


def _few_values(x: np.ndarray, y: np.ndarray) -> bool:
    return all(len(np.unique(v)) < math.sqrt(len(v)) for v in (x, y))


def dependence(x: np.ndarray, y: np.ndarray, asym: bool = False) -> tuple[float, float]:
    """(correlation, dependence), nonlinear; 0, 0 for a constant."""
    if np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0, 0.0
    corr, dep = _directional(x, y)
    if not asym:
        other = _directional(y, x)
        corr, dep = max(corr, other[0]), max(dep, other[1])
    if _few_values(x, y):
        co0, _, d0, _ = _co_moments(x, y)
        dep = (dep + math.sqrt((min(abs(co0 - 0.5) * 2, 1) + abs(d0 - 0.75) / 0.75) / 2)) / 2
    return corr, dep


def normalised(m: np.ndarray) -> np.ndarray:
    """Columns on a common scale (mean ratios weighted by absolute correlation; dependence from 10 columns on)."""
    d = m.shape[1]
    mean = m.mean(axis=0)
    mean = np.where(mean == 0, 1e-10, mean)
    if d < 10:
        with np.errstate(invalid="ignore", divide="ignore"):
            weight = np.abs(np.atleast_2d(np.corrcoef(m, rowvar=False)))
    else:
        weight = np.eye(d)
        for i in range(d):
            for j in range(i):
                weight[i, j] = weight[j, i] = dependence(m[:, i], m[:, j])[1]
    return m * (mean[:, None] / mean[None, :] * weight).mean(axis=0)


def _causation(x: np.ndarray, y: np.ndarray, tau: int) -> float:
    if tau > 0:
        n = len(x)
        x, y = (normalised(np.stack([v[tau - i : n - i] for i in range(tau + 1)], axis=1))[:, 0] for v in (x, y))
    m = normalised(np.stack([x, y], axis=1))
    x, y = m[:, 0], m[:, 1]

    def share(t: float, low: bool) -> float:
        a, b = np.maximum(0, t - x).sum(), np.maximum(0, x - t).sum()
        return float((a if low else b) / (a + b)) if a + b else math.nan

    p = 1 - (share(float(y.min()), True) + share(float(y.max()), False))
    ahead, back = dependence(y, x, True)[1], dependence(x, y, True)[1]
    return (p * ahead + max(0.0, ahead - back)) / 2


def causation(x: np.ndarray, y: np.ndarray, tau: int = 0) -> tuple[float, float, str, float]:
    """(x given y, y given x, direction, net), net capped at 100."""
    a, b = (v if math.isfinite(v) else 0.0 for v in (_causation(x, y, tau), _causation(y, x, tau)))
    eps = float(np.finfo(float).eps)
    forward = abs(b) >= abs(a)
    big, small = (b, a) if forward else (a, b)
    net = math.copysign(min(100.0, abs(math.log((abs(big) + eps) / (abs(small) + eps)))), big)
    return a, b, "x->y" if forward else "y->x", net


CENTRES = {"off": gravity, "mean": lambda v: float(v.mean()), "median": lambda v: float(np.median(v))}


def _centres(v: np.ndarray, start: np.ndarray, count: np.ndarray, centre: str) -> np.ndarray:
    """The centre of each cell of v, whose cells follow each other."""
    if centre == "mean":
        return np.add.reduceat(v, start) / count
    return np.array([CENTRES[centre](v[a : a + n]) for a, n in zip(start.tolist(), count.tolist(), strict=True)])


def cell_name(code: int) -> str:
    """q, then the digits of a code in base 5."""
    digits = ""
    while code:
        code, d = divmod(code, 5)
        digits = str(d) + digits
    return "q" + digits


def partition(x: np.ndarray, y: np.ndarray, x_only: bool = False, order: int | None = None, least: int = 8, stop: bool = True, centre: str = "off"):
    """(depth, quadrant labels, labels before the last split, regression points by those labels). Cells are numbers
    while they are split, a digit a round; their rows are sorted side by side, so a round costs one sort."""
    n = len(x)
    deepest = min(max(1, math.ceil(math.log2(max(1, n)))) if order is None else max(1, order), math.floor(math.log2(max(1, n))))
    code, prior, depth = np.zeros(n, np.int64), np.full(n, -1, np.int64), 0
    while depth < deepest:
        rows, start, count, _ = cells_of(code)
        big = count > least
        if not big.any():
            break
        own = rows[np.repeat(big, count)]
        size = count[big]
        first = np.cumsum(size) - size
        cx = np.repeat(_centres(x[own], first, size, centre), size)
        if x_only:
            digit = 1 + (x[own] > cx)
        else:
            digit = 1 + (x[own] <= cx) + 2 * (y[own] <= np.repeat(_centres(y[own], first, size, centre), size))
        prior[own] = code[own]
        code[own] = code[own] * 5 + digit
        depth += 1
        if stop and cells_of(code)[2].min() <= least:
            break
    rows, start, count, ids = cells_of(prior)
    px, py = (_centres(v[rows], start, count, centre) for v in (x, y))
    if np.all(x == np.floor(x)):
        px = np.floor(px + 0.5)
    name = lambda c: "pq" if c < 0 else cell_name(int(c))
    points = sorted((name(c), float(a), float(b)) for c, a, b in zip(ids, px, py, strict=True))

    def names(codes: np.ndarray) -> np.ndarray:
        value, place = np.unique(codes, return_inverse=True)
        return np.array([name(c) for c in value], object)[place]

    return depth, names(code), names(prior), points
