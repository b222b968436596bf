"""Models of one group at a time: Arrow-grouped kernels. A group must fit in one executor."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailwise.functions.expr import col
from tailwise.kernels import forecasts, multivariate, regression, series, stats
from tailwise.operators import quantile

#: Rows that nearest() sends to all tasks at most.
TRAIN_ROWS = 100_000


def _fields(df: DataFrame, groups: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{g}` {kinds[g]}, " for g in groups)


def _xy(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    return df.select(*groups, col(x).alias("x"), col(y).alias("y")).dropna(subset=["x", "y"])


def mode(df: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """groups, mode: the highest smoothed peak of each group."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, float(series.mode(pdf["x"].to_numpy())))], columns=[*groups, "mode"])

    return df.select(*groups, col(column).alias("x")).dropna(subset=["x"]).groupBy(*groups).applyInPandas(run, _fields(df, groups) + "mode double")


def forecast(df: DataFrame, value: str, order: str, groups: list[str], h: int, lags: list[int] | None = None, method: str = "lin", **how) -> DataFrame:
    """groups, step, forecast: recursive forecasts of each series by weighted lags; None: its steadiest period."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("_o", kind="stable")["x"].to_numpy()
        out = series.forecast(own, h, lags or forecasts.seasonal_lags(own)[0], method, **how)
        return pd.DataFrame([(*key, k + 1, float(v)) for k, v in enumerate(out)], columns=[*groups, "step", "forecast"])

    rows = df.select(*groups, F.col(order).alias("_o"), col(value).alias("x")).dropna(subset=["x"])
    return rows.groupBy(*groups).applyInPandas(run, _fields(df, groups) + "step int, forecast double")


def monte_carlo(df: DataFrame, value: str, order: str, groups: list[str], reps: int, rhos: list[float], seed: int = 0) -> DataFrame:
    """groups, rho, rep, i, x: bootstrap replicates, a task per series and rho. Draws depend on the seed, the
    group and rho, never on the partitioning."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        *group, rho = key
        own = pdf.sort_values("_o", kind="stable")["x"].to_numpy()
        number = zlib.crc32(repr((seed, [str(g) for g in group], rho)).encode())
        m = series.maximum_entropy_bootstrap(own, reps, rho, seed=number)
        n = len(own)
        out = {g: [v] * (n * reps) for g, v in zip(groups, group, strict=True)}
        return pd.DataFrame(out | {"rho": rho, "rep": np.repeat(np.arange(1, reps + 1), n), "i": np.tile(np.arange(1, n + 1), reps), "x": m.T.ravel()})

    rows = df.select(*groups, F.col(order).alias("_o"), col(value).alias("x"), F.explode(F.array(*[F.lit(float(r)) for r in rhos])).alias("rho")).dropna(subset=["x"])
    return rows.groupBy(*groups, "rho").applyInPandas(run, _fields(df, groups) + "rho double, rep int, i int, x double")


def nearest(train: DataFrame, points: DataFrame, features: list[str], y: str, key: str, k: int | None = None, classes: bool = False) -> DataFrame:
    """key, prediction for each point. train is the small side (regression points), bounded by TRAIN_ROWS and sent
    to all tasks; points stream past it."""
    rows = train.select(*[col(f).alias(f) for f in features], col(y).alias("_y")).dropna().limit(TRAIN_ROWS + 1).toPandas()
    if len(rows) > TRAIN_ROWS:
        raise ValueError(f"more than {TRAIN_ROWS} training rows: reduce them to regression points first")
    sent = train.sparkSession.sparkContext.broadcast((rows[features].to_numpy(), rows["_y"].to_numpy()))

    def run(frames):
        x, v = sent.value
        for pdf in frames:
            own = pdf[features].to_numpy()
            yield pd.DataFrame({key: pdf[key], "prediction": multivariate.nearest_many(x, v, own, k or len(x), classes, False) if len(own) else []})

    own = points.select(key, *[col(f).alias(f) for f in features])
    return own.mapInPandas(run, f"`{key}` {dict(points.dtypes)[key]}, prediction double")


def fit_regression(df: DataFrame, x: str, y: str, groups: list[str], **how) -> DataFrame:
    """groups, start, at_x, at_y, slope: the segments of each group's piecewise regression."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        rows = regression.segments(a, b, *regression.breakpoints(a, b, **how))
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*groups, "start", "at_x", "at_y", "slope"])

    return _xy(df, x, y, groups).groupBy(*groups).applyInPandas(run, _fields(df, groups) + "start double, at_x double, at_y double, slope double")


def score_regression(points: DataFrame, x: str, model: DataFrame, groups: list[str]) -> DataFrame:
    """points with estimate, NULL where x is. A group's segments, few whatever its rows, are one sorted array; rows pick
    theirs without Python."""
    keyed = model.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(F.sort_array(F.collect_list(F.struct("start", "at_x", "at_y", "slope"))).alias("_s"))
    out = points.join(keyed, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups], "left") if groups else points.join(F.broadcast(keyed))
    own = F.try_element_at(F.filter("_s", lambda s: s["start"] <= col(x)), F.lit(-1))
    return out.withColumn("_s", own).withColumn("estimate", F.col("_s.at_y") + (col(x) - F.col("_s.at_x")) * F.col("_s.slope")).drop("_s", *[f"_g_{g}" for g in groups])


def forecast_nonlinear(df: DataFrame, value: str, order: str, groups: list[str], h: int, lags: list[int] | None = None, **how) -> DataFrame:
    """groups, step, forecast: each lag's subsequence goes on along its piecewise regression. None: the steadiest period."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("_o", kind="stable")["x"].to_numpy()
        used, weights = (lags, series.lag_weights(own, lags)) if lags else forecasts.seasonal_lags(own)
        out = regression.forecast_nonlinear(own, h, used, weights, **how)
        return pd.DataFrame([(*key, k + 1, float(v)) for k, v in enumerate(out)], columns=[*groups, "step", "forecast"])

    rows = df.select(*groups, F.col(order).alias("_o"), col(value).alias("x")).dropna(subset=["x"])
    return rows.groupBy(*groups).applyInPandas(run, _fields(df, groups) + "step int, forecast double")


MODELS = {"surface": multivariate.fit_surface, "line": multivariate.fit_line, "stack": multivariate.fit_stack, "boost": multivariate.fit_boost}


def predict_by(train: DataFrame, points: DataFrame, features: list[str], y: str, key: str, groups: list[str], model: str = "surface", **how) -> DataFrame:
    """groups, key, prediction of each point by the model of its group's training rows: a surface over all features, a
    line along their weighted mean, both stacked, or boosted sets of them. Points of groups without training rows get
    null; rows with a null or no number are left out of the training."""
    fields = _fields(points, groups) + f"`{key}` {dict(points.dtypes)[key]}, "

    def run(group, own: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        out = at[[*groups, key]].assign(prediction=np.nan)
        if len(own) and len(at):
            x, v, t = own[features].to_numpy(), own["_y"].to_numpy(), at[features].to_numpy()
            ok = np.isfinite(t).all(axis=1)
            if ok.any():
                out.loc[ok, "prediction"] = MODELS[model](x, v, **how).predict(t[ok])
        return out

    known = train.select(*groups, *[col(f).alias(f) for f in features], col(y).alias("_y")).dropna(subset=[*features, "_y"])
    asked = points.select(*groups, key, *[col(f).alias(f) for f in features])
    return known.groupBy(*groups).cogroup(asked.groupBy(*groups)).applyInPandas(run, fields + "prediction double")


def fitted_by(train: DataFrame, features: list[str], y: str, key: str, groups: list[str], model: str = "surface", confidence: float | None = None, **how) -> DataFrame:
    """groups, key, y, fitted, residual (fitted - y), r2 and, for a surface, cell; with confidence low and high around
    the fitted value, by the partial-moment quantile of the residuals."""

    def run(group, own: pd.DataFrame) -> pd.DataFrame:
        x, v = own[features].to_numpy(), own["_y"].to_numpy()
        fit = MODELS[model](x, v, **how)
        out = own[[*groups, key]].assign(y=v, fitted=fit.fitted, residual=fit.fitted - v, r2=multivariate.r_squared(v, fit.fitted), cell=fit.cells if model == "surface" else None)
        if confidence is not None:
            width = abs(multivariate.tail_target(fit.fitted - v, (1 - confidence) / 2))
            out = out.assign(low=fit.fitted - width, high=fit.fitted + width)
        return out

    known = train.select(*groups, key, *[col(f).alias(f) for f in features], col(y).alias("_y")).dropna(subset=[*features, "_y"])
    tail = "y double, fitted double, residual double, r2 double, cell string" + ", low double, high double" * (confidence is not None)
    return known.groupBy(*groups).applyInPandas(run, _fields(train, groups) + f"`{key}` {dict(train.dtypes)[key]}, " + tail)


def feature_shares(train: DataFrame, features: list[str], y: str, groups: list[str], **how) -> DataFrame:
    """groups, feature, share: how often boosting keeps a set of columns with the feature."""

    def run(group, own: pd.DataFrame) -> pd.DataFrame:
        shares = multivariate.fit_boost(own[features].to_numpy(), own["_y"].to_numpy(), **how).shares
        return pd.DataFrame([(*group, f, float(v)) for f, v in zip(features, shares, strict=True)], columns=[*groups, "feature", "share"])

    known = train.select(*groups, *[col(f).alias(f) for f in features], col(y).alias("_y")).dropna()
    return known.groupBy(*groups).applyInPandas(run, _fields(train, groups) + "feature string, share double")


def forecast_best(df: DataFrame, value: str, order: str, groups: list[str], h: int, lags: list[int], held: int | None = None, **how) -> DataFrame:
    """groups, step, forecast, low, high, method, lags: by the lags and the method that forecast the last held values
    (h, if not given) of each series best."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("_o", kind="stable")["x"].to_numpy()
        negative = bool(own.min() < 0)
        best = forecasts.choose(own, held or h, lags, negative, **how)
        rows = zip(*best.forecast(own, h, negative), strict=True)
        named = ",".join(map(str, best.lags))
        return pd.DataFrame([(*key, k + 1, *map(float, r), best.method, named) for k, r in enumerate(rows)], columns=[*groups, "step", "forecast", "low", "high", "method", "lags"])

    rows = df.select(*groups, F.col(order).alias("_o"), col(value).alias("x")).dropna(subset=["x"])
    return rows.groupBy(*groups).applyInPandas(run, _fields(df, groups) + "step int, forecast double, low double, high double, method string, lags string")


def regression_table(points: DataFrame, x: str, y: str, model: DataFrame, groups: list[str], confidence: float = 0.95) -> DataFrame:
    """points with estimate, slope, residual (estimate - y), standard_error of the rows of that slope, and intervals: low
    and high around the estimate by the partial-moment quantile of their residuals, y_low and y_high by the quantiles of
    their ys. All by aggregates; no group meets in one task."""
    alpha = (1 - confidence) / 2
    keyed = model.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(F.sort_array(F.collect_list(F.struct("start", "at_x", "at_y", "slope"))).alias("_s"))
    rows = points.join(keyed, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]) if groups else points.join(F.broadcast(keyed))
    rows = rows.withColumn("_s", F.try_element_at(F.filter("_s", lambda s: s["start"] <= col(x)), F.lit(-1))).drop(*[f"_g_{g}" for g in groups])
    rows = rows.withColumn("estimate", F.col("_s.at_y") + (col(x) - F.col("_s.at_x")) * F.col("_s.slope")).withColumn("slope", F.col("_s.slope")).drop("_s")
    rows = rows.withColumn("residual", F.col("estimate") - col(y))
    parts = [*groups, "slope"]
    errors = rows.groupBy(*parts).agg(F.sqrt(F.sum(F.col("residual") ** 2) / F.greatest(F.count("*") - 1, F.lit(1))).alias("standard_error"))
    width = quantile.upm_var(rows, "residual", alpha, 1, parts).withColumnRenamed("var", "_width")
    low, high = (quantile.lpm_var(rows, y, p, 0, parts).withColumnRenamed("var", n) for p, n in ((alpha, "y_low"), (1 - alpha, "y_high")))
    out = rows
    for part in (errors, width, low, high):
        own = part.withColumnsRenamed({c: f"_p_{c}" for c in parts})
        out = out.join(own, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in parts], "left").drop(*[f"_p_{c}" for c in parts])
    return out.withColumns({"low": F.col("estimate") - F.abs("_width"), "high": F.col("estimate") + F.abs("_width")}).drop("_width")


def mean_slope(points: DataFrame, x: str, model: DataFrame, groups: list[str]) -> DataFrame:
    """groups, slope: the mean slope of the fitted regression over the points, its overall derivative."""
    keyed = model.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(F.sort_array(F.collect_list(F.struct("start", "slope"))).alias("_s"))
    rows = points.join(keyed, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]) if groups else points.join(F.broadcast(keyed))
    own = F.try_element_at(F.filter("_s", lambda s: s["start"] <= col(x)), F.lit(-1))["slope"]
    return rows.groupBy(*groups).agg(F.avg(own).alias("slope"))
