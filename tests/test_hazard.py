import math

import numpy as np
import pytest

from tailwise.kernels import regression as kernel
from tailwise.operators import grouped, hazard


def brute(v, degree):
    """The same with NumPy, one group at a time; None without a slope."""
    x = np.sort(v)
    low = np.array([np.mean(np.where(x <= t, np.abs(t - x) ** degree, 0.0)) for t in x])
    up = np.array([np.mean(np.where(x > t, np.abs(x - t) ** degree, 0.0)) for t in x])
    total = low + up
    p = np.divide(low, total, out=np.zeros_like(low), where=total > 0)
    n = len(x)
    place, half = np.arange(n), min(10, n - 1) // 2
    a, b = np.maximum(0, place - half), np.minimum(n - 1, place + half)
    ok = x[b] > x[a]
    if not ok.any():
        return {t: None for t in x}
    slope = np.maximum((p[b] - p[a])[ok] / (x[b] - x[a])[ok], 1e-10)
    fit = kernel.predict(kernel.segments(x[ok], slope, *kernel.breakpoints(x[ok], slope)), x)
    return dict(zip(x.tolist(), np.clip(fit / np.maximum(1 - p, 1e-10), 0, 1e6).tolist(), strict=True))


def test_hazard(spark):
    rng = np.random.default_rng(7)
    own = {"wait": rng.exponential(size=150), "ties": np.floor(rng.exponential(size=120) * 9), "four": np.array([1.0, 2.0, 3.0, 4.0]), "two": np.array([1.0, 5.0]), "same": np.full(30, 4.0), None: rng.normal(size=41) - 3}
    rows = [(g, float(v), 1) for g, vs in own.items() for v in vs] + [("wait", None, 1), ("wait", math.nan, 1), ("four", math.inf, 1), ("void", None, 1)]
    df = spark.createDataFrame(rows, "g string, `a.b` double, _n int").repartition(5)
    got = {}
    for r in hazard.hazard(df, "`a.b`", 1, ["g"]).collect():
        got.setdefault(r["g"], {})[r["v"]] = r["h"]
    assert set(got) == set(own)
    for g, v in own.items():
        want = brute(v, 1)
        assert got[g].keys() == want.keys(), g
        for t, h in want.items():
            assert got[g][t] == (h if h is None else pytest.approx(h, rel=1e-6, abs=1e-8)), (g, t)


def test_points_without_x_have_no_estimate(spark):
    model = spark.createDataFrame([("a", -math.inf, 0.0, 1.0, 2.0), ("a", 1.0, 1.0, 3.0, 0.0)], "g string, start double, at_x double, at_y double, slope double")
    points = spark.createDataFrame([("a", 0.5), ("a", None), ("a", 4.0)], "g string, x double")
    assert [r["estimate"] for r in grouped.score_regression(points, "x", model, ["g"]).orderBy("x").collect()] == [None, 2.0, 3.0]
