import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailwise.kernels import derivative, forecasts, multivariate, regression, series, stats
from tailwise.operators import categorical, cells, central, dominance, grouped, hypothesis, moments, quantile, timeseries


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=200)
    rows = [("a" if k % 2 else "b", float(v), float(v**2 + e)) for k, (v, e) in enumerate(zip(x, rng.normal(size=200), strict=True))]
    return spark.createDataFrame(rows, "g string, x double, y double").cache()


def test_tiny_moments(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.5,), (3.0,)], "x double")
    r = moments.partial_moments(df, "x", [2], target=F.lit(0.0)).first()
    assert (r["lpm2"], r["upm2"]) == (1.25, 2.3125)


def test_equality_belongs_to_the_lower_side(spark):
    r = moments.partial_moments(spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "x double"), "x", [0], target=F.lit(2.0)).first()
    assert (r["lpm0"], r["upm0"]) == (1.0, 0.0)


def test_co_moments_make_the_covariance(xy):
    r = moments.co_moments(xy, "x", "y", 1, 1).first()
    assert r["clpm"] + r["cupm"] - r["dlpm"] - r["dupm"] == pytest.approx(xy.agg(F.covar_pop("x", "y")).first()[0])


def test_tied_copulas(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double")
    assert moments.copula(df, ["a", "b"]).first()["copula"] == 1.0


def test_var_inverts_the_ratio(xy):
    for p in (0.05, 0.25, 0.7):
        for degree in (1, 2):
            t = quantile.lpm_var(xy, "x", p, degree).first()["var"]
            assert moments.partial_moments(xy, "x", [degree], target=F.lit(t)).first()[f"lpm_ratio{degree}"] == pytest.approx(p, abs=1e-9)


def test_gravity_of_few_values(spark):
    """Up to three values: their median, ties counted."""
    own = {"one": [4.0], "two": [1.0, 4.0], "three": [135.0, 141.5, 141.5], "apart": [9.0, 1.0, 2.0], "same": [5.0, 5.0, 5.0]}
    df = spark.createDataFrame([(g, v) for g, vs in own.items() for v in vs], "g string, y double")
    assert {r["g"]: r["gravity"] for r in central.gravity(df, "y", ["g"]).collect()} == {"one": 4.0, "two": 2.5, "three": 141.5, "apart": 2.0, "same": 5.0}


def test_gravity_equals_kernel(xy):
    for r in central.gravity(xy, "y", ["g"]).collect():
        own = np.array([s["y"] for s in xy.where(F.col("g") == r["g"]).collect()])
        assert r["gravity"] == pytest.approx(stats.gravity(own))


def test_shift_dominates(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=300)
    df = spark.createDataFrame([("lo", float(x)) for x in v] + [("hi", float(x) + 1) for x in v], "g string, v double")
    for degree in (1, 2, 3):
        flags = {(r["x"], r["y"]): r["dominates"] for r in dominance.dominance(df, "g", "v", ["lo", "hi"], degree).collect()}
        assert flags == {("hi", "lo"): True, ("lo", "hi"): False}
    assert dominance.efficient_set(df, "g", "v", ["lo", "hi"], 2) == ["hi"]
    assert dominance.clusters(df, "g", "v", ["lo", "hi"], 2) == [["hi"], ["lo"]]


def test_dependence_bounds():
    x = np.linspace(0, 1, 200)
    corr, dep = stats.dependence(x, x**3)
    assert corr > 0.9 and dep > 0.9
    assert stats.dependence(x, np.ones(200)) == (0.0, 0.0)


def test_partition_labels_are_nested():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 128))
    depth, label, prior, points = stats.partition(x, y)
    assert depth >= 1 and all(a.startswith(b) for a, b in zip(label, prior, strict=True)) and [p[0] for p in points] == sorted(p[0] for p in points)


def test_linear_static_continues_a_line(spark):
    df = spark.createDataFrame([(k, float(5 + 2 * k)) for k in range(24)], "t int, v double")
    got = [r["forecast"] for r in timeseries.linear_static(df, "v", "t", 4, 6).orderBy("step").collect()]
    assert got == pytest.approx([5 + 2 * (24 + k) for k in range(6)])


def test_seasonality_finds_the_period(spark):
    df = spark.createDataFrame([(k, 10 + math.sin(2 * math.pi * k / 6)) for k in range(60)], "t int, v double")
    assert 6 in {r["period"] for r in timeseries.seasonality(df, "v", "t").collect()}


def test_bootstrap_keeps_order_and_correlation():
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=80)) + 20
    same = series.maximum_entropy_bootstrap(x, 20, 1.0, seed=1)
    assert np.array_equal(same, series.maximum_entropy_bootstrap(x, 20, 1.0, seed=1))
    assert np.mean([np.corrcoef(x, same[:, k])[0, 1] for k in range(20)]) > 0.8
    assert same.mean() == pytest.approx(x.mean(), abs=0.2)


def test_rho_grid():
    assert np.allclose(series.rho_grid(-1, 1, 0.5), [1, 0.5, 0, -0.5, -1])


def test_neighbours():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    y = np.array([0.0, 1.0, 2.0, 3.0])
    assert series.nearest(x, y, np.array([1.1]), 1) == 1.0
    assert 0.5 < series.nearest(x, y, np.array([1.1]), 3) < 2
    assert series.nearest(x, np.array([1.0, 1.0, 2.0, 2.0]), np.array([0.1]), classes=True) == 1.0
    assert series.neighbour_weights(np.array([0.1, 0.2, 0.4])).sum() == pytest.approx(1)


def test_forecast_of_a_line_and_a_season():
    assert series.forecast(np.arange(1.0, 25), 3, [1]) == pytest.approx([25, 26, 27])
    season = np.tile([1.0, 5.0, 9.0], 8)
    assert series.forecast(season, 3, [3], "means") == pytest.approx([1, 5, 9])


def test_modes():
    assert series.mode(np.array([1.0, 2, 2, 3, 3]), discrete=True) == 2.5
    rng = np.random.default_rng(0)
    two = np.concatenate([rng.normal(0, 1, 3000), rng.normal(20, 1, 1000)])
    assert abs(series.mode(two)) < 1


def test_two_point_regression():
    x, y = np.array([1.0, 2.0]), np.array([148.0, 135.0])
    px, py = regression.breakpoints(x, y)
    assert py.tolist()[0] == 148.0 and 135.0 <= py.min()


def test_regression_follows_a_curve(spark):
    x = np.linspace(-2, 2, 300)
    y = x**3
    rows = regression.segments(x, y, *regression.breakpoints(x, y))
    assert 1 - np.var(regression.predict(rows, x) - y) / np.var(y) > 0.97
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)], "g string, x double, y double")
    got = grouped.score_regression(df, "x", grouped.fit_regression(df, "x", "y", ["g"]), ["g"]).orderBy("x").collect()
    assert [r["estimate"] for r in got] == pytest.approx(regression.predict(rows, x))


def test_nonlinear_forecast_of_a_season():
    season = np.tile([1.0, 5.0, 9.0], 8)
    assert regression.forecast_nonlinear(season, 3, [3], np.ones(1)) == pytest.approx([1, 5, 9])


#: Two years of a monthly series.
MONTHS = np.array([112, 118, 132, 129, 121, 135, 148, 148, 136, 119, 104, 118, 115, 126, 141, 135, 125, 149, 170, 170, 158, 133, 114, 140], float)


def test_known_forecasts(spark):
    assert series.forecast(MONTHS, 6, [12]) == pytest.approx([118, 134, 150, 141, 129, 163], abs=1e-9)
    lags, weights = forecasts.seasonal_lags(MONTHS)
    assert lags == [9] and regression.forecast_nonlinear(MONTHS, 4, lags, weights) == pytest.approx([128.5, 113.5, 155.5, 213.66666666666666], abs=1e-9)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(MONTHS)], "g string, t int, v double")
    got = [r["forecast"] for r in grouped.forecast_nonlinear(df, "v", "t", ["g"], 4).orderBy("step").collect()]
    assert got == pytest.approx([128.5, 113.5, 155.5, 213.66666666666666])
    best = grouped.forecast_best(df, "v", "t", ["g"], 6, [2, 3, 4, 6], held=6).collect()
    assert len(best) == 6 and all(r["low"] <= r["forecast"] <= r["high"] for r in best)


def test_choice_of_lags_finds_the_season():
    season = np.tile([10.0, 20.0, 60.0, 30.0], 15)
    best = forecasts.choose(season, 8, [2, 3, 4, 5])
    assert best.lags[0] == 4 and best.error == pytest.approx(0)
    assert best.forecast(season, 4, False)[0] == pytest.approx([10, 20, 60, 30])


def test_known_stack(spark):
    x0 = np.linspace(0, 1, 12)
    x, y = np.column_stack((x0, np.sin(x0))), 1 + 2 * x0 - np.sin(x0)
    fit = multivariate.fit_stack(x, y, folds=2, share=0.25)
    surface, line = fit.parts(x[:3])
    assert surface == pytest.approx([1.0, 1.13692627, 1.13692627], abs=1e-8)
    assert line == pytest.approx([1.0, 1.09196524, 1.18444508], abs=1e-8)
    assert fit.predict(x[:3]) == pytest.approx([1.0, 1.09216537, 1.18423356], abs=1e-8)
    assert (fit.n_best, fit.threshold) == (1, 0.0)
    train = spark.createDataFrame([("a", k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "g string, id int, x1 double, x2 double, y double")
    points = train.where("id < 3").unionByName(train.where("id = 3").withColumn("g", F.lit("b")))
    got = {r["id"]: r["prediction"] for r in grouped.predict_by(train, points, ["x1", "x2"], "y", "id", ["g"], "stack", folds=2).collect()}
    assert [got[k] for k in range(3)] == pytest.approx([1.0, 1.09216537, 1.18423356], abs=1e-8) and (got[3] is None or math.isnan(got[3]))
    for model in ("surface", "line", "boost"):
        assert grouped.predict_by(train, points, ["x1", "x2"], "y", "id", ["g"], model).count() == 4
    fitted = grouped.fitted_by(train, ["x1", "x2"], "y", "id", ["g"], confidence=0.95).collect()
    assert len(fitted) == 12 and all(r["low"] <= r["fitted"] <= r["high"] for r in fitted)


def test_surface_goes_on_beyond_the_data():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (200, 2))
    y = x @ [3.0, 1.0]
    fit = multivariate.fit_surface(x, y)
    assert multivariate.r_squared(y, fit.fitted) > 0.9
    inside, outside = fit.predict(np.array([[0.5, 0.5]]))[0], fit.predict(np.array([[1.5, 1.5]]))[0]
    assert outside > inside
    classes = multivariate.fit_surface(x, np.floor(y), classes=True)
    assert set(classes.predict(rng.uniform(-1, 2, (50, 2)))) <= set(range(5))


def test_boosting_finds_the_column():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    shares = multivariate.fit_boost(x, 5 * x[:, 1]).shares
    assert shares.argmax() == 1 and shares.sum() == pytest.approx(1)


def test_neighbours_of_many_targets():
    rng = np.random.default_rng(6)
    x, y, at = rng.normal(size=(40, 3)), rng.normal(size=40), rng.normal(size=(300, 3)) * 2
    for k in (1, 4, 40):
        assert multivariate.nearest_many(x, y, at, k, population=False) == pytest.approx([series.nearest(x, y, t, k) for t in at])
    c = np.floor(y)
    assert multivariate.nearest_many(x, c, at, 7, True, False) == pytest.approx([series.nearest(x, c, t, 7, True) for t in at])


def test_wide_matrix_equals_narrow(xy, monkeypatch):
    columns = ["x", "y", "z"]
    df = xy.withColumn("z", F.col("x") * F.col("y"))
    rows = lambda: {(r["g"], r["row"], r["col"]): r for r in moments.pm_matrix(df, columns, 1, 2, True, groups=["g"]).collect()}
    narrow = rows()
    monkeypatch.setattr(moments, "WIDE", 2)
    wide = rows()
    assert narrow.keys() == wide.keys() and len(wide) == 18
    for k, r in narrow.items():
        assert [wide[k][c] for c in ("clpm", "cupm", "dlpm", "dupm", "covariance")] == pytest.approx([r[c] for c in ("clpm", "cupm", "dlpm", "dupm", "covariance")])


def test_matrix_of_many_columns(spark):
    many = [f"c{k}" for k in range(200)]
    df = spark.range(500).select(*[F.randn(k).alias(c) for k, c in enumerate(many)])
    rows = moments.pm_matrix(df, many, 1, 1).where("row = 'c3' and col = 'c150'").collect()
    assert rows[0]["covariance"] == pytest.approx(df.agg(F.covar_pop("c3", "c150")).first()[0])


@pytest.mark.parametrize("degree", [3, 4])
def test_var_of_higher_degrees(xy, degree):
    for p in (0.05, 0.5, 0.9):
        t = {r["g"]: r["var"] for r in quantile.lpm_var(xy, "y", p, degree, ["g"]).collect()}
        for g, v in t.items():
            r = moments.partial_moments(xy.where(F.col("g") == g), "y", [degree], target=F.lit(v)).first()
            assert r[f"lpm_ratio{degree}"] == pytest.approx(p, abs=1e-7)


def test_multivariate_cdf_in_blocks(xy, monkeypatch):
    rows = [(r["x"], r["y"]) for r in xy.select("x", "y").collect()]
    points = xy.sparkSession.createDataFrame([(k, *rows[k]) for k in range(40)] + [(40, None, 1.0)], "id int, x double, y double")
    got = {r["id"]: r["value"] for r in quantile.cdf_nd(xy, ["x", "y"], points, "id").collect()}
    assert got == pytest.approx({k: np.mean([x <= rows[k][0] and y <= rows[k][1] for x, y in rows]) for k in range(40)})
    hazard = quantile.cdf_nd(xy, ["x", "y"], points, "id", 1, "cumulative hazard").collect()
    assert all(r["value"] >= 0 for r in hazard)


def test_anova_of_equal_and_shifted_groups(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=300)
    df = spark.createDataFrame([(g, float(x) + s) for g, s in (("a", 0), ("b", 0), ("c", 9)) for x in v], "g string, v double")
    got = {(r["a"], r["b"]): r["certainty"] for r in hypothesis.anova(df, "g", "v").collect()}
    assert got["a", "b"] > 0.98 and got["a", "c"] < 0.01
    whole = hypothesis.anova_all(df, "g", "v").first()["certainty"]
    assert 0 <= whole <= 1
    pair = hypothesis.anova_pair(df, "g", "v", "c", "a").first()
    assert pair["control"] == pytest.approx(9 + v.mean()) and pair["certainty"] == pytest.approx(got["a", "c"])


def test_regression_table(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 200)
    df = spark.createDataFrame([("a", float(a), float(np.sin(a) + e)) for a, e in zip(x, rng.normal(size=200) / 5, strict=True)], "g string, x double, y double")
    model = grouped.fit_regression(df, "x", "y", ["g"])
    rows = grouped.regression_table(df, "x", "y", model, ["g"]).collect()
    assert len(rows) == 200 and all(r["low"] <= r["estimate"] <= r["high"] and r["y_low"] <= r["y_high"] for r in rows)
    for s in {r["slope"] for r in rows}:
        own = np.array([r["residual"] for r in rows if r["slope"] == s])
        assert all(r["standard_error"] == pytest.approx(math.sqrt((own**2).sum() / max(1, len(own) - 1))) for r in rows if r["slope"] == s)
    assert grouped.mean_slope(df, "x", model, ["g"]).first()["slope"] == pytest.approx(np.mean([r["slope"] for r in rows]))


def test_balanced_classes(spark):
    df = spark.createDataFrame([("a", k) for k in range(7)] + [("b", k) for k in range(3)], "c string, k int")
    up = categorical.up_sample(df, "c", keys=["k"]).collect()
    assert sum(r["c"] == "b" for r in up) == sum(r["c"] == "a" for r in up) == 7 and {r["k"] for r in up if r["c"] == "b"} == {0, 1, 2}
    assert categorical.up_sample(df.limit(0), "c").count() == 0
    assert categorical.down_sample(df, "c").groupBy("c").count().select("count").distinct().collect()[0][0] == 3


def test_rolling_clusters(spark):
    rng = np.random.default_rng(8)
    rows = [(w, g, float(x) + s * (1 if w else -1)) for w in (0, 1) for g, s in (("lo", 0), ("hi", 1)) for x in rng.normal(size=100).round(1)]
    df = spark.createDataFrame(rows, "w int, g string, v double")
    got = {(r["w"], r["g"]): r["cluster"] for r in dominance.rolling_clusters(df, "w", "g", "v", 2).collect()}
    for w in (0, 1):
        want = dominance.clusters(df.where(F.col("w") == w), "g", "v", ["hi", "lo"], 2)
        assert {g: k + 1 for k, own in enumerate(want) for g in own} == {g: c for (v, g), c in got.items() if v == w}
    sets = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c")], "w int, g string")
    assert [(r["size"], r["turnover"]) for r in dominance.turnover(sets, "w", "g").orderBy("w").collect()] == [(2, None), (2, pytest.approx(2 / 3))]


def test_derivatives():
    square = derivative.derivative(lambda v: v * v, 3.0)
    assert square.slope == pytest.approx(6, abs=1e-6) and square.mean == pytest.approx(6)
    assert derivative.derivative(np.sin, 1.0).slope == pytest.approx(math.cos(1), abs=1e-6)
    flat = derivative.derivative(lambda v: 2 * v + 1, 5.0)
    assert (flat.slope, flat.code) == (pytest.approx(2), 0)
    assert derivative.derivative(lambda v: v**3, 0.0).slope == pytest.approx(0, abs=1e-3)
    with pytest.raises(ValueError):
        derivative.derivative(np.sin, 1.0, 0)


def test_divisors_make_the_same_periods(spark):
    rng = np.random.default_rng(7)
    v = 20 + rng.normal(size=97) + 5 * np.sin(np.arange(97) * 2 * np.pi / 8)
    got = {r["period"]: r["cv"] for r in timeseries.seasonality(spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "t int, v double"), "v", "t").collect()}
    cv = lambda x: abs(np.std(x, ddof=1) / np.mean(x)) if len(x) > 1 else np.nan
    base, want = cv(v), {}
    for p in range(1, 49):
        own = [cv(v[: 97 - s][::-p]) for s in range(3)]
        own = [base if np.isnan(c) else c for c in own]
        if max(own) <= base:
            want[p] = np.mean(own)
    assert got == pytest.approx(want)
