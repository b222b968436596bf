"""The k-nearest join against brute force, with ties, outlying points, missing numbers and repeated keys."""

import numpy as np
import pytest

from tailwise.kernels import multivariate
from tailwise.operators import neighbours


@pytest.mark.parametrize(("k", "classes"), [(1, False), (5, False), (6, True)])
def test_nearest_equals_brute_force(spark, monkeypatch, k, classes):
    monkeypatch.setattr(neighbours, "ROWS", 20)
    rng = np.random.default_rng(k)
    x = np.round(rng.normal(size=(400, 2)), 1)
    x[:60] = 0.5  # more equal rows than a box holds
    y = rng.integers(0, 4, 400).astype(float) if classes else rng.normal(size=400)
    t = np.vstack([np.round(rng.normal(size=(50, 2)), 2), x[:5], [[40.0, 0.0], [-9.0, 9.0]]])
    train = spark.createDataFrame([(float(a), float(b), float(c), k) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))] + [(None, 1.0, 1.0, -1), (1.0, 1.0, None, -2)], "a double, b double, y double, o int")
    points = spark.createDataFrame([(j % 55, float(a), float(b)) for j, (a, b) in enumerate(t)] + [(99, None, 1.0)], "id int, a double, b double")
    got = neighbours.nearest(train, points, ["a", "b"], "y", "id", k, classes, "o").collect()
    want = multivariate.nearest_many(x, y, t, k, classes, False)
    pairs = sorted((j % 55, round(float(v), 9)) for j, v in enumerate(want))
    assert sorted((r["id"], round(r["prediction"], 9)) for r in got if r["id"] != 99) == pairs
    assert [r["prediction"] for r in got if r["id"] == 99] == [None]


def test_nearest_without_rows(spark):
    train = spark.createDataFrame([], "a double, y double")
    points = spark.createDataFrame([(1, 2.0)], "id int, a double")
    assert neighbours.nearest(train, points, ["a"], "y", "id", 3).first()["prediction"] is None
    one = spark.createDataFrame([(1.0, 7.0)], "a double, y double")
    assert neighbours.nearest(one, points, ["a"], "y", "id", 3).first()["prediction"] == 7
    assert neighbours.nearest(one, points.limit(0), ["a"], "y", "id", 3).collect() == []


def test_nearest_meets_equal_points_once_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 20)
    monkeypatch.setattr(neighbours, "TASK_ROWS", 100, raising=False)
    meetings, write = [], neighbours.step

    def step(df, name):
        out = write(df, name)
        if name == "meetings":
            meetings.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "step", step)
    train = spark.createDataFrame([(float(k % 30), float(k)) for k in range(120)], "a double, y double")
    for copies in (1, 40):
        points = spark.createDataFrame([(k, float(k % 30) + 0.25) for k in range(30 * copies)], "id int, a double")
        out = neighbours.nearest(train, points, ["a"], "y", "id", 1)
        assert sorted(map(tuple, out.collect())) == [(k, float(k % 30)) for k in range(30 * copies)]
        assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert meetings[0] == meetings[1]
