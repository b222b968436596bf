import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailwise.kernels import regression as kernel
from tailwise.operators import regression, smoothing


def samples():
    rng = np.random.default_rng(11)
    n = 60
    line = np.arange(n) / 7 - 3.0
    ties, uneven = np.floor(rng.random(n) * 12), line + rng.random(n) / 9  # no centre falls on a value
    return {
        "noise": (rng.normal(size=n), rng.normal(size=n)),
        "curve": (uneven, np.sin(uneven) + rng.normal(0, 0.05, n)),
        "ties": (ties, ties**2 + rng.normal(size=n)),
        "line": (line, 2 * line + 1),
        "flat": (line, np.full(n, 2.0)),
        "far": (line + 1e6, np.exp(line / 4) + rng.normal(0, 0.01, n) + 1e6),
        "long": (rng.normal(size=400), rng.normal(size=400).cumsum()),
        "one": (np.array([3.0]), np.array([4.0])),
        "two": (np.array([1.0, 2.0]), np.array([148.0, 135.0])),
        None: (rng.exponential(size=90), rng.normal(size=90)),
    }


def table(spark, own, extra=()):
    rows = [(g, float(a), float(b), "q") for g, (x, y) in own.items() for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame([*rows, *extra], "g string, `a.b` double, y double, _dep string").repartition(5)


def basis(t, d, z):
    """All B-splines of degree d at z by their recursion, whose last interval takes its end in."""
    if d == 0:
        last = max(k for k in range(len(t) - 1) if t[k] < t[k + 1])
        return np.array([((t[k] <= z) & (z < t[k + 1])) | ((k == last) & (z == t[k + 1])) for k in range(len(t) - 1)], float)
    low = basis(t, d - 1, z)
    out = np.zeros((len(t) - 1 - d, len(z)))
    for k in range(len(out)):
        if t[k + d] > t[k]:
            out[k] += (z - t[k]) / (t[k + d] - t[k]) * low[k]
        if t[k + d + 1] > t[k + 1]:
            out[k] += (t[k + d + 1] - z) / (t[k + d + 1] - t[k + 1]) * low[k + 1]
    return out


def brute_spline(x, y, spar, at):
    """Whole matrices; roughness by differences of coefficients, whose second derivatives are linear between knots."""
    tol = 1e-6 * (np.quantile(x, 0.75) - np.quantile(x, 0.25))
    _, first, w = np.unique(np.round((x - x.mean()) / tol), return_index=True, return_counts=True)
    place = np.unique(np.round((x - x.mean()) / tol), return_inverse=True)[1]
    u = np.array([x[place == k].min() for k in range(len(first))])
    mean = np.array([y[place == k].mean() for k in range(len(first))])
    z, n = (u - u[0]) / np.ptp(u), len(u)
    logs = np.log2([50, 100, 140, 200])
    m = n if n < 50 else int(2 ** np.interp(n, [50, 200, 800, 3200], logs)) if n < 3200 else int(200 + (n - 3200) ** 0.2)
    inner = z if m == n else z[np.trunc(np.linspace(1.0, n, m)).astype(int) - 1]
    t = np.r_[[0.0] * 3, inner, [1.0] * 3]
    b = basis(t, 3, z)
    # Second derivatives at both ends of each interval: two rounds of differences of the coefficients.
    eye, k = np.eye(m + 2), m + 2
    one = np.array([3 * (eye[j + 1] - eye[j]) / (t[j + 4] - t[j + 1]) for j in range(k - 1)])
    two = np.array([2 * (one[j + 1] - one[j]) / (t[j + 4] - t[j + 2]) for j in range(k - 2)])
    rough = sum(h / 6 * (2 * np.outer(p, p) + np.outer(p, q) + np.outer(q, p) + 2 * np.outer(q, q)) for p, q, h in zip(two, two[1:], np.diff(inner), strict=False))
    fit, inside = b * w @ b.T, slice(2, k - 3)
    weight = np.trace(fit[inside, inside]) / np.trace(rough[inside, inside]) * 16 ** (6 * spar - 2)
    c = np.linalg.solve(fit + weight * rough, b @ (w * mean))
    return c @ basis(t, 3, (at - u[0]) / np.ptp(u))


def test_regression_by_aggregates(spark):
    own = samples()
    odd = [("one", None, 1.0, "q"), ("two", 2.0, math.nan, "q"), ("none", None, None, "q")]
    got = {}
    for r in regression.fit_regression(table(spark, own, odd), "`a.b`", "y", ["g"]).collect():
        got.setdefault(r["g"], []).append((r["start"], r["at_x"], r["at_y"], r["slope"]))
    assert set(got) == set(own)
    for g, (x, y) in own.items():
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        want = kernel.segments(x, y, *kernel.breakpoints(x, y))
        found = sorted(got[g])
        assert len(found) == len(want), g
        # The last row starts beyond the last point; where rows share an end, the least y is the observed one.
        seen = (float(y[x == x.max()].min()), *want[-1][3:])
        assert np.array(found)[:-1] == pytest.approx(np.array(want)[:-1], rel=1e-6, abs=1e-7), g
        assert found[-1] == pytest.approx((want[-1][0], want[-1][1], *seen), rel=1e-6, abs=1e-7), g
        assert found[-1][0] == want[-1][0], g
    assert regression.fit_regression(table(spark, own).where("false"), "y", "y").collect() == []


def test_regression_of_an_order(spark):
    own = {g: v for g, v in samples().items() if g in ("curve", "ties", "line")}
    found = {}
    for r in regression.fit_regression(table(spark, own), "`a.b`", "y", ["g"], 3, "mean").collect():
        found.setdefault(r["g"], []).append((r["start"], r["at_x"], r["at_y"]))
    for g, (x, y) in own.items():
        px, py = kernel.breakpoints(x, y, 3, "mean")
        assert np.array(sorted(found[g])[1:-1])[:, 1:] == pytest.approx(np.stack([px, py], axis=1), rel=1e-6, abs=1e-7), g


@pytest.mark.parametrize("spar", [0.2, 0.7])
def test_smoothing_spline(spark, spar):
    rng = np.random.default_rng(3)
    own = {g: samples()[g] for g in ("noise", "curve", "ties", "long", None)}
    x = rng.normal(size=5000)
    own |= {"many": (x, np.sin(3 * x) + rng.normal(0, 0.3, len(x))), "four": (np.array([0.0, 1, 2, 5]), np.array([1.0, 3, 2, 7])), "three": (np.array([0.0, 1, 2]), np.zeros(3)), "still": (np.r_[np.zeros(20), 1, 2, 3, 4], np.arange(24.0))}
    df = table(spark, own, [("many", None, 1.0, "q"), ("many", 1.0, math.nan, "q")])
    model = smoothing.smoothing_spline(df, "`a.b`", "y", ["g"], spar)
    got = {}
    for r in smoothing.score_pieces(df.select("g", F.col("`a.b`").alias("x")), "x", model, ["g"]).where("x is not null").collect():
        got.setdefault(r["g"], []).append((r["x"], r["estimate"]))
    for g in ("three", "still"):
        assert all(v is None for _, v in got.pop(g))
    for g, found in got.items():
        at, value = np.array(sorted(found)).T
        assert value == pytest.approx(brute_spline(*own[g], spar, at), rel=1e-6, abs=1e-6), g
    whole = smoothing.smoothing_spline(df.where("g = 'many'"), "`a.b`", "y", spar=spar)
    assert whole.count() == 200 + int(1800**0.2) - 1
    assert smoothing.smoothing_spline(df.where("false"), "y", "y").collect() == []


def test_smooth_regression(spark):
    own = {g: v for g, v in samples().items() if g in ("curve", "noise", "long", "two", None)}
    df = table(spark, own)
    pieces = regression.fit_smooth(df, "`a.b`", "y", ["g"])
    points = spark.createDataFrame([(g, float(v)) for g, (x, _) in own.items() for v in (*x, x.min() - 1, x.max() + 2)], "g string, x double")
    got = {}
    for r in smoothing.score_pieces(points, "x", pieces, ["g"]).collect():
        got.setdefault(r["g"], []).append((r["x"], r["estimate"]))
    for g, (x, y) in own.items():
        px, py = kernel.breakpoints(x, y)
        at, value = np.array(sorted(got[g])).T
        if len(px) < 4:
            want = kernel.predict(kernel.segments(x, y, px, py), at)
        else:
            spar = (kernel.strength(x, y) + 0.5) / 2
            rows = kernel.segments(x, y, px, brute_spline(px, py, spar, px))
            inside = (at >= x.min()) & (at <= x.max())
            want = np.where(inside, brute_spline(px, py, spar, np.clip(at, x.min(), x.max())), kernel.predict(rows, at))
        assert value == pytest.approx(want, rel=1e-6, abs=1e-6), g
