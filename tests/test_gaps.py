import math

import numpy as np
import pytest

from tailwise.kernels import regression, stats
from tailwise.operators import gaps


def brute(v):
    """The same fill with NumPy, one series at a time."""
    place = np.arange(1, len(v) + 1.0)
    ok = ~np.isnan(v)
    if not ok.any():
        return ["unknown"] * len(v), v
    x, y = place[ok], v[ok]
    dep = regression.strength(x, y)
    cx, cy = math.floor(stats.gravity(x) + 0.5), stats.gravity(y)
    ends = [float(y[0 if low else -1]) if dep >= 1 else regression._edge(x, y, cx, low, dep, False) for low in (True, False)]
    px, py = regression.merged([cx, x.min(), x.max(), cx], [cy, *ends, cy])
    rows = regression.segments(x, y, px, np.clip(py, y.min(), y.max()))
    kind = ["known" if k else "before" if p < x.min() else "trailing" if p > x.max() else "inside" for k, p in zip(ok, place, strict=True)]
    fit = regression.predict(rows, place)
    return kind, np.array([a if k == "known" else math.nan if k == "trailing" else f for k, a, f in zip(kind, v, fit, strict=True)])


def test_gaps_of_series(spark):
    rng = np.random.default_rng(5)
    n = 41
    line = np.arange(-2.0, n - 2)
    samples = {
        "line": line, "noise": rng.normal(size=n), "curve": np.exp(line / 15) + rng.normal(0, 0.05, n), "flat": np.full(n, 2.0),
        "none": np.full(n, math.nan), "one": np.where(np.arange(n) == 7, 3.0, math.nan), "two": np.where(np.isin(np.arange(n), (5, 11)), line, math.nan), None: rng.normal(size=n).cumsum(),
    }
    holes = {"line": [4], "noise": [0, 1, 9, 10, 20], "curve": [0, 7, 8, 40], "flat": [3, 40], None: [0, 15, 16, 17, 30]}
    for g, at in holes.items():
        samples[g] = samples[g].copy()
        samples[g][at] = math.nan
    rows = [(g, t, float(a), None if math.isnan(b := v[-1 - t]) else float(b)) for g, v in samples.items() for t, a in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, t int, `a.b` double, column2 double").repartition(5)
    got = {}
    for r in gaps.fill_gaps(df, ["`a.b`", "column2"], "t", ["g"]).collect():
        got.setdefault((r["g"], r["column"]), []).append((r["t"], r["kind"], r["value"]))
    assert len(got) == 2 * len(samples)
    for g, v in samples.items():
        for name, own in (("`a.b`", v), ("column2", v[::-1])):
            kind, want = brute(own)
            found = sorted(got[g, name])
            assert [k for _, k, _ in found] == kind, (g, name)
            assert [math.nan if a is None else a for *_, a in found] == pytest.approx(want.tolist(), nan_ok=True, abs=1e-9), (g, name)
    assert gaps.fill_gaps(df.where("t < 0"), ["column2"], "t", ["g"]).collect() == []
