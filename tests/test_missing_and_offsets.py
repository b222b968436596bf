"""NULL and NaN, values far from 0, tables of targets, cut groups, cells and pairs as rows, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailwise.functions.expr import lpm, upm
from tailwise.kernels import stats
from tailwise.operators import cells, cumulative, dominance, moments, quantile

NAN = float("nan")


@pytest.fixture(scope="module")
def gaps(spark):
    """x and y with nulls, in two groups, one of which is null."""
    rng = np.random.default_rng(3)
    rows = [(g, *(None if rng.random() < 0.2 else float(v) for v in rng.normal(size=3))) for g in ("a", None) for _ in range(60)]
    return spark.createDataFrame(rows, "g string, x double, y double, z double"), rows


def test_nulls_are_no_observations(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    m = moments.moments(df, "x").first()
    assert (m["mean"], m["variance"]) == (2.0, pytest.approx(2 / 3))
    r = moments.partial_moments(df, "x", [0, 1, 2], target=2.5).first()
    assert r["lpm0"] + r["upm0"] == 1 and r["lpm0"] == pytest.approx(2 / 3)
    assert r["lpm1"] == pytest.approx(2 / 3) and r["upm1"] == pytest.approx(0.5 / 3) and r["lpm2"] == pytest.approx(2.5 / 3)
    moving = df.withColumn("t", F.when(F.col("x") > 1, F.col("x") + 1))
    assert moments.partial_moments(moving, "x", [1], target=F.col("t")).first()["lpm1"] == 1


def test_nan_is_on_neither_side_of_degree_0_and_spoils_the_rest(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (NAN,)], "x double")
    r = df.agg(lpm("x", 2, 0).alias("a"), upm("x", 2, 0).alias("b"), lpm("x", 2, 1).alias("c"), upm("x", 2, 2).alias("d")).first()
    assert r["a"] == r["b"] == pytest.approx(1 / 3) and math.isnan(r["c"]) and math.isnan(r["d"])


def test_co_moments_of_complete_rows(gaps):
    df, rows = gaps
    both = np.array([(x, y) for _, x, y, _ in rows if x is not None and y is not None])
    r = moments.co_moments(df, "x", "y", 1, 1).first()
    assert r["clpm"] + r["cupm"] - r["dlpm"] - r["dupm"] == pytest.approx(np.cov(both.T, ddof=0)[0, 1])
    three = np.array([v for _, *v in rows if None not in v])
    at = three - three.mean(axis=0)
    nd = moments.co_moments_nd(df, ["x", "y", "z"], 0).first()
    assert nd["co_lpm_nd"] == pytest.approx((at <= 0).all(axis=1).mean())
    small = {(r["row"], r["col"]): r["covariance"] for r in moments.pm_matrix(df, ["x", "y", "z"], 1, 1).collect()}
    assert small["x", "z"] == pytest.approx(np.cov(three.T, ddof=0)[0, 2])
    wide = df.select("*", *[F.lit(float(k)).alias(f"c{k}") for k in range(14)])
    large = {(r["row"], r["col"]): r["covariance"] for r in moments.pm_matrix(wide, ["x", "y", "z", *[f"c{k}" for k in range(14)]], 1, 1).collect()}
    assert large["x", "z"] == pytest.approx(small["x", "z"]) and large["c3", "z"] == pytest.approx(0)


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_far_from_zero(spark, offset):
    v = np.round(np.random.default_rng(5).normal(size=300), 3)
    df = spark.createDataFrame([(float(x + offset),) for x in v], "x double")
    want = lambda t, d: np.maximum(0, t - v) ** d
    got = {round(r["v"] - offset, 3): r["CDF"] for r in quantile.cdf(df, "x", 2).collect()}
    for t in (-1.0, 0.0, 1.5):
        near = min(got, key=lambda k: abs(k - t))
        low, up = want(near, 2).sum(), (np.maximum(0, v - near) ** 2).sum()
        assert got[near] == pytest.approx(low / (low + up), abs=1e-6)
    at = quantile.lpm_var(df, "x", 0.25, 2).first()["var"] - offset
    low, up = want(at, 2).sum(), (np.maximum(0, v - at) ** 2).sum()
    assert low / (low + up) == pytest.approx(0.25, abs=1e-5)
    targets = spark.createDataFrame([(offset + t,) for t in (-9.0, 0.25, 9.0)], "t double")
    for r in quantile.partial_moments_at(df, "x", targets, "t", [0, 1, 4]).collect():
        t = r["t"] - offset
        assert r["lpm0"] == pytest.approx((v <= t).mean()) and r["lpm1"] == pytest.approx(want(t, 1).mean(), abs=1e-6)
        assert r["lpm4"] == pytest.approx(want(t, 4).mean(), rel=1e-5, abs=1e-6)
    two = spark.createDataFrame([(g, float(x + offset + s)) for g, s in (("low", 0.0), ("high", 0.001)) for x in v], "g string, x double")
    assert {(r["x"], r["y"]) for r in dominance.dominance(two, "g", "x", None, 3, 1e-9).where("dominates").collect()} == {("high", "low")}


def test_targets_outside_and_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("a", NAN)], "g string, x double")
    targets = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 1.5), ("a", 1.5), ("a", 2.0), ("a", 2.5), ("b", 1.0)], "g string, t double")
    got = {(r["g"], r["t"]): r["CDF"] for r in quantile.cdf_at(df, "x", targets, "t", 0, ["g"]).collect()}
    assert got == {("a", 0.0): None, ("a", 1.0): 0.5, ("a", 1.5): 0.5, ("a", 2.0): 1.0, ("a", 2.5): None, ("b", 1.0): None}
    assert quantile.partial_moments_at(df, "x", targets, "t", [1], ["g"]).where("g = 'b'").first()["lpm1"] is None


def test_cut_groups_equal_whole_ones(gaps, monkeypatch):
    df, rows = gaps
    sums = lambda: {(r["g"], r["v"]): (r["n_le"], r["d_le"], r["n_all"], r["v_after"], round(r["s2_le"], 9), r["c"]) for r in cumulative.cumulative(df, "x", ["g"], powers=2).collect()}
    whole = sums()
    monkeypatch.setattr(cumulative, "SPLIT", 5)
    assert sums() == whole
    for g in ("a", None):
        own = sorted(x for k, x, *_ in rows if k == g and x is not None)
        for i, x in enumerate(own):
            n, d, total, after, *_ = whole[g, x]
            assert (n, d, total, after) == (i + 1, i + 1, len(own), own[i + 1] if i + 1 < len(own) else None)


def test_cells_equal_the_kernel(spark):
    rng = np.random.default_rng(4)
    samples = {"a": (rng.normal(size=7), rng.normal(size=7)), "c": (x := rng.normal(size=300), np.sin(3 * x) + rng.normal(0, 0.3, 300)), "d": (k := rng.integers(0, 5, 120).astype(float), np.round(k * k + rng.normal(0, 0.4, 120))), "e": (np.full(50, 1.5), rng.normal(size=50)), None: (x, x)}
    df = spark.createDataFrame([(g, float(a), float(b)) for g, (p, q) in samples.items() for a, b in zip(p, q, strict=True)] + [("a", None, 1.0)], "g string, x double, y double")
    got = {r["g"]: (r["correlation"], r["dependence"]) for r in cells.dependence(df, "x", "y", ["g"]).collect()}
    assert got.keys() == samples.keys()
    for g, (p, q) in samples.items():
        assert got[g] == pytest.approx(stats.dependence(p, q)), g
    for how in ({"centre": "mean"}, {"stop": False, "order": 2}):
        rows = cells.partition(df, "x", "y", ["g"], **how).collect()
        points = cells.partition(df, "x", "y", ["g"], points=True, **how).collect()
        for g, (p, q) in samples.items():
            _, quadrant, prior, found = stats.partition(p, q, **how)
            assert sorted((r["x"], r["y"], r["quadrant"], r["prior"]) for r in rows if r["g"] == g) == sorted(zip(p, q, quadrant, prior, strict=True))
            own = sorted((r["prior"], r["x"], r["y"]) for r in points if r["g"] == g)
            assert [c for c, *_ in own] == [c for c, *_ in found] and np.allclose([v for _, *v in own], [v for _, *v in found])


def test_norm_of_ten_columns_weights_by_dependence(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(5, 1, size=(80, 10))
    x[:, 3] = x[:, 0] ** 2
    names = [f"c{k}" for k in range(10)]
    got = {r["column"]: r["scale"] for r in cells.norm_scales(spark.createDataFrame(x.tolist(), names), names).collect()}
    mean, weight = x.mean(axis=0), np.eye(10)
    for i in range(10):
        for j in range(i):
            weight[i, j] = weight[j, i] = stats.dependence(x[:, i], x[:, j])[1]
    assert got == pytest.approx(dict(zip(names, (mean[:, None] / mean[None, :] * weight).mean(axis=0), strict=True)))


def test_dominance_of_many_names_and_windows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(2, 12, 20)) + np.linspace(0, 2, 12)[None, :, None], 1)
    df = spark.createDataFrame([(w, f"n{k:02d}", float(x)) for w in range(2) for k in range(12) for x in v[w, k]] + [(None, "n01", 1.0), (1, None, 1.0), (1, "n01", None)], "w int, g string, v double")
    monkeypatch.setattr(dominance, "BLOCK", 3)
    for degree in (1, 2, 3):
        got = {(r["w"], r["x"], r["y"]) for r in dominance.dominance(df.where("w is not null"), "g", "v", None, degree, 1e-9, ["w"]).where("dominates").collect()}
        want = set()
        for w in range(2):
            for i in range(12):
                for j in range(12):
                    a, b = v[w, i], v[w, j]
                    at = np.concatenate([a, b])
                    height = lambda s, at=at, degree=degree: np.array([((s <= t) if degree == 1 else np.maximum(0, t - s) ** (degree - 1)).mean() for t in at])
                    p, q = height(a), height(b)
                    ok = i != j and not (p - q > 1e-9 * abs(q)).any() and (abs(p - q) > 1e-9 * abs(q)).any() and a.min() >= b.min()
                    if ok and (degree == 1 or a.mean() >= b.mean()):
                        want.add((w, f"n{i:02d}", f"n{j:02d}"))
        assert got == want and want
    star = {(r["x"], r["y"]): (r["p_gt"], r["p_tie"]) for r in dominance.superiority(df.where("w = 0"), "g", "v").collect()}
    assert len(star) == 132
    a, b = v[0, 3], v[0, 9]
    assert star["n03", "n09"] == pytest.approx(((a[:, None] > b).mean(), (a[:, None] == b).mean()))
    assert star["n09", "n03"] == pytest.approx(((b[:, None] > a).mean(), (a[:, None] == b).mean()))


def test_multivariate_cdf_of_three_columns(gaps):
    df, rows = gaps
    full = np.array([v for _, *v in rows if None not in v])
    points = df.sparkSession.createDataFrame([(k, *map(float, full[k] + 0.1)) for k in range(12)] + [(90, -99.0, 0.0, 0.0), (91, None, 0.0, 0.0)], "id int, x double, y double, z double")
    for degree in (0, 1):
        got = {r["id"]: r["value"] for r in quantile.cdf_nd(df, ["x", "y", "z"], points, "id", degree).collect()}
        want = {}
        for k, at in [(k, full[k] + 0.1) for k in range(12)] + [(90, np.array([-99.0, 0, 0]))]:
            u = at - full
            size = np.abs(u**degree).prod(axis=1)
            want[k] = size[(u >= 0).all(axis=1)].sum() / size.sum()
        assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("order", ["y", "y desc", "rand(1)", "rand(2)"])
def test_rows_on_a_cell_mean(spark, order):
    """A row that equals its cell's mean lies at or below it, in whatever order the mean is added up: seven prices, six
    times, around the third, under a cell of one price."""
    y = [38.24864, 38.26518, 38.27714, 38.27871, 38.284819999999996, 38.289339999999996, 38.296150000000004]
    rows = [(0, 35.0, v) for v in y * 6 + [100.1] * 42]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(1).sortWithinPartitions(F.expr(order.split()[0]).desc() if "desc" in order else F.expr(order))
    got = {(r["y"], r["quadrant"]) for r in cells.partition(df, "x", "y", ["g"], order=2, stop=False, centre="mean").collect()}
    assert got == {(v, "q44" if v <= y[2] else "q42") for v in y} | {(100.1, "q24")}


def test_equal_rows_are_one(spark):
    """Rows equal in x and y go through the levels once, with their number; results are those of the rows one by one."""
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b)) for a, b in rng.normal(size=(40, 2))] * 5
    df = spark.createDataFrame([(0, *r) for r in rows], "g int, x double, y double")
    merged = cells._merged(cells._pairs_of(df, "x", "y", ["g"]), ["g"])
    assert merged.count() == 40 and merged.agg(F.sum("_times")).first()[0] == 200
    key = [*"g", "_c"]
    one, many = (cells._concordance(r.withColumn("_c", F.lit(1)), key).first().asDict() for r in (df, merged))
    assert one == pytest.approx(many)


@pytest.mark.parametrize("how", [{"order": 3}, {"stop": False, "order": 3, "points": True}])
def test_small_cells_are_split_to_the_end_at_once(spark, monkeypatch, how):
    """Once cells are small, one table of cells is written instead of one a level; rows and points stay those of the levels.
    Group 1 is eleven points six times each, so cells of one point are split on; one row has an infinite x."""
    rng = np.random.default_rng(6)
    rows = [(None, float(a), float(b)) for a, b in rng.normal(size=(90, 2))] + [(None, float("inf"), 0.5)]
    rows += [(1, float(a), float(b)) for a, b in rng.normal(size=(11, 2))] * 6
    df, made = spark.createDataFrame(rows, "g int, x double, y double").repartition(3), []
    real = cells.step
    monkeypatch.setattr(cells, "step", lambda df, name: made.append(name) or real(df, name))
    found = {}
    for most in (100, 0):
        monkeypatch.setattr(cells, "LOCAL", most)
        made.clear()
        found[most] = sorted(map(repr, cells.partition(df, "x", "y", ["g"], **how).select(*[F.round(c, 9).alias(c) if c in "xy" else c for c in ("g", "prior", "x", "y")]).collect()))
        assert (made.count("cells") == 1) == (most > 0)
    assert found[100] == found[0]
