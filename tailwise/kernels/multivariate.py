"""Regression on several columns for one group: regression points by cells of all columns, reduction to one column,
and the mean of both weighted by cross-validated errors."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np

from tailwise.kernels import regression, series
from tailwise.kernels.stats import causation, dependence, gravity

#: Targets whose distances are computed together.
BLOCK = 256


def tail_target(x: np.ndarray, p: float) -> float:
    """Where the upper ratio of degree 1 is p."""
    s, p = np.sort(x[np.isfinite(x)]), 1 - p
    if not len(s):
        return math.nan
    n, k, run = len(s), np.arange(1, len(s) + 1), np.cumsum(s)
    low, up = s * k - run, run[-1] - run - s * (n - k)
    total = low + up
    ratio = np.divide(low, total, out=np.zeros(n), where=total > 0)
    at = max(0, int(np.searchsorted(ratio, p, side="right")) - 1)
    if at == n - 1:
        return float(s[-1])
    return float(((1 - p) * run[at] + p * (run[-1] - run[at])) / ((1 - p) * k[at] + p * (n - k[at])))


def nearest_many(features: np.ndarray, y: np.ndarray, targets: np.ndarray, k: int, classes: bool = False, population: bool = True) -> np.ndarray:
    """Predictions at many targets from their k nearest rows, each target scaled together with the rows."""
    k, out = min(k, len(features)), np.empty(len(targets))
    low, high = features.min(axis=0), features.max(axis=0)
    for a in range(0, len(targets), BLOCK):
        t = targets[a : a + BLOCK]
        span = np.maximum(high, t) - np.minimum(low, t)
        diff = np.abs(features[None] - t[:, None]) / np.where(span > 0, span, 1.0)[:, None]
        d = (diff * diff + diff).sum(axis=2)
        d[d == 0] = 1e-10
        if k == 1:
            out[a : a + BLOCK] = y[d.argmin(axis=1)]
            continue
        own = np.argsort(d, axis=1, kind="stable")[:, :k]
        for i, row in enumerate(own):
            w = series.neighbour_weights(d[i, row], population)
            if classes:
                value, place = np.unique(y[row], return_inverse=True)
                out[a + i] = value[np.argmax(np.bincount(place, weights=np.ceil(100 * w)))]
            else:
                out[a + i] = y[row] @ w
    return out


def to_class(v: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(v + 0.5), y.min(), y.max())


@dataclass
class Surface:
    """A fitted regression: its points (features, y), neighbours, range of the data, fitted values."""

    points: np.ndarray
    heights: np.ndarray
    k: int
    low: np.ndarray
    high: np.ndarray
    fitted: np.ndarray
    cells: np.ndarray
    breaks: list[np.ndarray]
    classes: bool
    bounds: tuple[float, float]

    def predict(self, at: np.ndarray) -> np.ndarray:
        """Beyond the data the estimate at its edge goes on along the way from the centre: slopes from the centre, from
        half and from three quarters of the way, the longer ones weighing more."""
        near = lambda t: nearest_many(self.points, self.heights, t, self.k, self.classes)
        out = near(at)
        far = np.flatnonzero(((at < self.low) | (at > self.high)).any(axis=1))
        if len(far):
            edge = np.clip(at[far], self.low, self.high)
            centre = np.array([gravity(c) for c in self.points.T])
            height, slope, stop = near(edge), np.zeros(len(far)), np.broadcast_to(centre, edge.shape)
            for weight in (3, 2, 1):
                run = np.sqrt(((edge - stop) ** 2).sum(axis=1))
                slope += weight / 6 * (height - near(stop)) / np.maximum(run, 1e-10)
                stop = (edge + stop) / 2
            out[far] = height + slope * np.sqrt(((at[far] - edge) ** 2).sum(axis=1))
        return np.clip(np.floor(out + 0.5), *self.bounds) if self.classes else out


def fit_surface(x: np.ndarray, y: np.ndarray, order: int | str | None = None, n_best: int | str | None = None, centre: str = "off", classes: bool = False) -> Surface:
    """Each column is cut at its own breakpoints; the rows of a cell of all columns become one point."""
    n, d = x.shape
    whole = order == "max"
    breaks = [np.sort(c) if whole else regression.breakpoints(c, y, order, centre, classes)[0] for c in x.T]
    place = np.stack([np.searchsorted(b, c, side="right") for b, c in zip(breaks, x.T, strict=True)], axis=1)
    name = np.array([".".join(map(str, p)) for p in place.tolist()])
    cells, own = np.unique(name, return_inverse=True)
    rows = np.argsort(own, kind="stable")
    parts = np.split(rows, np.cumsum(np.bincount(own))[:-1])
    middle = {"off": gravity, "mean": np.mean, "median": np.median, "mode": series.mode, "mode_class": lambda v: series.mode(v, discrete=True)}[centre]
    table = np.column_stack([x, y])
    points = np.array([table[p[0]] if whole else [float(middle(c)) for c in table[p].T] for p in parts])
    fitted = points[own, -1]
    fitted = to_class(fitted, y) if classes else fitted
    rest = fitted - y
    fitted = fitted - np.array([gravity(rest[p]) for p in parts])[own]
    if n_best is None:
        k = 1 if whole else max(1, math.floor((1 - regression.copula(table)) * math.sqrt(d)))
    else:
        k = len(points) if n_best == "all" else max(1, int(n_best))
    if k > 1:
        fitted = nearest_many(points[:, :-1], points[:, -1], x, k, classes)
    fitted = to_class(fitted, y) if classes else fitted
    return Surface(points[:, :-1], points[:, -1], k, x.min(axis=0), x.max(axis=0), fitted, name, breaks, classes, (float(y.min()), float(y.max())))


def r_squared(y: np.ndarray, fitted: np.ndarray) -> float:
    a, b = y - y.mean(), fitted - y.mean()
    below = float((a @ a) * (b @ b))
    return float(a @ b) ** 2 / below if below > 0 else math.nan


# --- reduction to one column


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    v = series._corr(a, b, "spearman")
    return v if math.isfinite(v) else 0.0


def coefficients(x: np.ndarray, y: np.ndarray, method="cor", tau: int = 0) -> np.ndarray:
    """A weight for each column: rank correlation, dependence, causation, their mode with 1, or 1; or numbers given."""
    if not isinstance(method, str):
        own = np.asarray(method, float)
        return np.where(np.isfinite(own), own, 0.0)
    rank = lambda c: spearman(c, y)
    dep = lambda c: dependence(c, y, True)[1]
    caus = lambda c: causation(y, c, tau)[0]
    one = {"cor": rank, "dep": dep, "caus": caus, "equal": lambda c: 1.0, "all": lambda c: float(series.mode(np.array([caus(c), dep(c), rank(c), 1.0])))}[method]
    return np.array([one(c) for c in x.T])


@dataclass
class Line:
    """A regression on the weighted mean of the scaled columns."""

    weights: np.ndarray
    active: int
    star: np.ndarray
    segments: list
    x: np.ndarray
    fitted: np.ndarray

    def project(self, at: np.ndarray) -> np.ndarray:
        """Points are scaled together with the data."""
        low, high = np.minimum(self.x.min(axis=0), at.min(axis=0)), np.maximum(self.x.max(axis=0), at.max(axis=0))
        return (at - low) / np.where(high > low, high - low, 1.0) @ self.weights / self.active

    def predict(self, at: np.ndarray) -> np.ndarray:
        return regression.predict(self.segments, self.project(at))


def fit_line(x: np.ndarray, y: np.ndarray, method="cor", threshold: float = 0.0, order: int | None = None, centre: str = "off", classes: bool = False, tau: int = 0) -> Line:
    """Weights below the threshold count as 0; if that leaves nothing, the columns are taken as they are."""
    given = coefficients(x, y, method, tau)
    weights = np.where(np.abs(given) < threshold, 0.0, given)
    span = np.ptp(x, axis=0)
    scaled = np.where(span > 0, (x - x.min(axis=0)) / np.where(span > 0, span, 1.0), 0.0) * weights
    if not scaled.any():
        scaled, weights = x, np.where(weights == 0, given, weights)
    active = max(1, int((np.abs(weights) > 0).sum()))
    star = (scaled / active).sum(axis=1)
    depth = max(1, math.floor(regression.strength(star, y) * 10)) if order is None else max(1, math.floor(order + 0.5))
    if len(y) < 100:
        depth = math.floor(max(1.0, depth / 2) + 0.5)
    segments = regression.segments(star, y, *regression.breakpoints(star, y, max(1, depth), centre, classes))
    return Line(weights, active, star, segments, x, regression.predict(segments, star))


# --- both together


def folds_of(n: int, folds: int, share: float):
    """(training rows, test rows) of each fold: test rows are spread evenly from the fold's number to the end."""
    for fold in range(1, folds + 1):
        test = np.clip(np.linspace(fold, n, max(1, int(share * n))).astype(int) - 1, 0, n - 1)
        rest = np.setdiff1d(np.arange(n), test)
        if not len(rest):
            raise ValueError("folds leave no rows for training")
        yield rest, test


def thresholds(x: np.ndarray, y: np.ndarray, method="cor") -> np.ndarray:
    """Candidates: the columns' weights by size, the greatest left out; 0 too for two columns."""
    if method == "equal":
        return np.zeros(1)
    own = np.abs(np.round(coefficients(x, y, method), 2))
    own = np.unique(own[own < 1])[::-1][1:]
    own = own if len(own) else np.zeros(1)
    return np.unique(np.append(own, 0.0)) if x.shape[1] == 2 else own


def squared(predicted: np.ndarray, y: np.ndarray) -> float:
    return float(((predicted - y) ** 2).sum())


def filled(v: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(v), v, gravity(v))


def _rechunked(m: np.ndarray) -> np.ndarray:
    """A fixed convention of the neighbour search in cross-validation: values by columns are read as rows."""
    return np.ravel(m, order="F").reshape(m.shape)


def _paths(features: np.ndarray, fitted: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Means of fitted values over the 1, 2, ... nearest rows by inverse distance, for each target."""
    diff = np.abs(_rechunked(features)[None] - _rechunked(at)[:, None])
    d = (diff * diff + diff).sum(axis=2)
    d[d == 0] = 1e-12
    own = np.argsort(d, axis=1, kind="stable")
    w = 1 / np.take_along_axis(d, own, axis=1)
    return np.cumsum(w * fitted[own], axis=1) / np.cumsum(w, axis=1)


def best_neighbours(folds, order: int | None, rows: int) -> int:
    """The most chosen number of neighbours over folds of (x, y, test x, test y); rows is how many the data have. A fold
    stops once two more neighbours in a row have not helped."""
    most, chosen = max(1, math.floor(math.sqrt(rows))), []
    for a, v, b, want in folds:
        surface = fit_surface(a, v, order, 1)
        paths, errors, tried = _paths(a, surface.fitted, b), [], []
        for k in [*range(1, most + 1), rows]:
            guess = surface.predict(b) if k == 1 else paths[:, min(k, paths.shape[1]) - 1]
            errors.append(squared(guess, want))
            tried.append(k)
            if len(errors) > 3 and errors[-1] >= max(errors[-2], errors[-3]):
                break
        chosen.append(tried[int(np.nanargmin(errors))])
    return int(math.floor(float(series.mode(np.array(chosen, float), discrete=True)) + 0.5))


@dataclass
class Stack:
    surface: Surface
    line: Line
    shares: np.ndarray
    n_best: int
    threshold: float
    columns: np.ndarray | None  # of the surface; None: the line's projection, twice

    def parts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.column_stack([filled(self.line.project(at))] * 2) if self.columns is None else at[:, self.columns]
        return self.surface.predict(own), self.line.predict(at)

    def predict(self, at: np.ndarray) -> np.ndarray:
        a, b = self.parts(at)
        a, b = np.where(np.isfinite(a), a, b), np.where(np.isfinite(b), b, a)
        return self.shares[0] * a + self.shares[1] * b


def _best_threshold(x: np.ndarray, y: np.ndarray, at: np.ndarray, want: np.ndarray, method, order) -> tuple[float, Line]:
    best = None
    for t in thresholds(x, y, method):
        fit = fit_line(x, y, method, float(t), order)
        error = squared(filled(fit.predict(at)), want)
        if best is None or error < best[0]:
            best = (error, float(t), fit)
    return best[1], best[2]


def fit_stack(x: np.ndarray, y: np.ndarray, folds: int = 5, share: float = 0.25, method="cor", order: int | None = None, star: bool = True) -> Stack:
    """The surface and the line, weighted by the inverse squares of their errors. The line's threshold and the surface's
    neighbours are chosen by folds; with star the surface is fitted on the line's projection, there twice, else on the
    columns of positive weight."""
    n, found, cases = len(y), [], []
    twice = lambda v: np.column_stack([v, v])
    for rows, test in folds_of(n, folds, share):
        threshold, line = _best_threshold(x[rows], y[rows], x[test], y[test], method, order)
        found.append(threshold)
        cases.append((rows, test, twice(line.star), twice(filled(line.project(x[test])))))
    value, count = np.unique(found, return_counts=True)
    threshold = gravity(value[count == count.max()])
    line = fit_line(x, y, method, threshold, order)
    columns = None if star else np.flatnonzero(line.weights > 0) if (line.weights > 0).any() else np.arange(x.shape[1])
    sides = ((a, y[rows], b, y[test]) if star else (x[rows][:, columns], y[rows], x[test][:, columns], y[test]) for rows, test, a, b in cases)
    n_best = best_neighbours(sides, order, n)
    surface = fit_surface(twice(line.star) if star else x[:, columns], y, order, n_best)
    errors = np.array([squared(surface.fitted, y), squared(line.fitted, y)])
    shares = np.maximum(1e-10, 1 / np.where(errors == 0, 1e-10, errors) ** 2)
    return Stack(surface, line, shares / shares.sum(), n_best, threshold, columns)


# --- boosting: which columns help


@dataclass
class Boost:
    surface: Surface
    line: Line
    shares: np.ndarray  # how often each column is in a set that is kept

    def predict(self, at: np.ndarray) -> np.ndarray:
        star = filled(self.line.project(at))
        return filled(self.surface.predict(np.column_stack([star, star])))


def five_numbers(v: np.ndarray) -> np.ndarray:
    """Least, lower hinge, median, upper hinge, greatest."""
    s = np.sort(v[np.isfinite(v)])
    hinge = math.floor((len(s) + 3) / 2) / 2
    at = np.array([1, hinge, (len(s) + 1) / 2, len(s) + 1 - hinge, len(s)]) - 1
    return (s[np.floor(at).astype(int)] + s[np.ceil(at).astype(int)]) / 2


def _trial_error(x: np.ndarray, y: np.ndarray, columns: tuple[int, ...], number: int, share: float, order, rng) -> float:
    """Squared error of a set of columns on held-out rows: early trials hold out evenly spread rows, later ones drawn.
    The five numbers of every column join the training rows."""
    n = len(y)
    size = max(1, int(share * n))
    test = np.clip(np.linspace(number, n, size).astype(int) - 1, 0, n - 1) if number <= n / 4 else rng.choice(n, size, replace=False)
    rest = np.setdiff1d(np.arange(n), test)
    table = np.column_stack([y, x])[rest]
    table = np.vstack([np.column_stack([five_numbers(c) for c in table.T]), table])
    own, v, at = table[:, 1:][:, columns], table[:, 0], x[test][:, columns]
    if len(columns) == 1:
        guess = regression.predict(regression.segments(own[:, 0], v, *regression.breakpoints(own[:, 0], v, order)), at[:, 0])
    else:
        guess = fit_line(own, v, "equal", 0.0, order).predict(at)
    return squared(filled(guess), y[test])


def fit_boost(x: np.ndarray, y: np.ndarray, share: float = 0.25, order: int | None = None, trials: int = 100, epochs: int | None = None, seed: int = 0) -> Boost:
    """Sets of columns are tried on held-out rows, all of them where they are few; those no worse than the lower hinge
    are kept, and a column weighs by how many of them have it. The weighted projection is then a surface's column."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    few = d <= 10 or 2**d - 1 < n
    if few:
        sets = [c for r in range(1, d + 1) for c in itertools.combinations(range(d), r)]
    else:
        sets = [tuple(sorted(rng.choice(d, int(rng.integers(2, d + 1)), replace=False).tolist())) for _ in range(trials)]
    errors = np.array([_trial_error(x, y, c, k, share, order, rng) for k, c in enumerate(sets, 1)])
    limit = five_numbers(errors)[1]
    kept = [c for c, e in zip(sets, errors, strict=True) if e <= limit]
    tally = lambda some: np.bincount(np.array([k for c in some for k in c], int), minlength=d).astype(float)
    if not few and kept:
        count = tally(kept)
        pool = np.repeat(np.arange(d), np.floor(count / count[count > 0].min() + 0.5).astype(int))
        tried = [tuple(np.unique(rng.choice(pool, int(rng.integers(1, d + 1)))).tolist()) for _ in range(epochs or 2 * n)]
        kept = [c for k, c in enumerate(tried, 1) if _trial_error(x, y, c, k, share, order, rng) <= limit]
    if not kept:
        kept = [sets[int(np.nanargmin(errors))]]
    shares = tally(kept) / tally(kept).sum()
    line = fit_line(x, y, shares, 0.0, order)
    star = filled(line.star)
    twice = np.column_stack([star, star])
    n_best = best_neighbours(((twice[r], y[r], twice[t], y[t]) for r, t in folds_of(n, 5, share)), None, n)
    return Boost(fit_surface(twice, y, None, n_best), line, shares)
