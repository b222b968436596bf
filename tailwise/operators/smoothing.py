"""Cubic smoothing splines with a fixed parameter: rows become sums of their interval, never a matrix of rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailwise.functions.expr import col, finite
from tailwise.operators.cumulative import beside, cumulative, same
from tailwise.sources.staging import step

#: A piece of a spline: from start on, a + b * u + c * u ** 2 + d * u ** 3 with u = x - at_x.
PIECE = ["start", "at_x", "a", "b", "c", "d"]
#: Values that differ by less than this share of the interquartile range are one.
TOLERANCE = 1e-6
#: Fewest values of a spline.
VALUES = 4
#: Values up to which all are knots, and the knots at 200, 800 and 3200 values (fixed values).
ALL_KNOTS = 50
KNOTS = [(50, 50), (200, 100), (800, 140), (3200, 200)]


def knots_of(u: Column) -> Column:
    """The number of knots for u distinct values: all below 50, then geometric between fixed numbers, at last
    200 + (u - 3200) ** 0.2, which is 451 at 10 ** 12."""
    out = F.when(u < ALL_KNOTS, u.cast("double"))
    for (a, m), (b, k) in zip(KNOTS, KNOTS[1:], strict=False):
        low, high = math.log2(m), math.log2(k)
        out = out.when(u < b, F.floor(F.pow(F.lit(2.0), low + (high - low) * (u - a) / (b - a))))
    top, most = KNOTS[-1]
    return out.otherwise(F.floor(most + F.pow((u - top).cast("double"), F.lit(0.2)))).cast("long")


def _spread(values: DataFrame, groups: list[str]) -> DataFrame:
    """groups, _tol, _mean: the tolerance from the interpolated quartiles of sorted values, and the mean."""
    n = F.col("n_all")
    parts = []
    for p in (0.25, 0.75):
        place = (n - 1) * p
        low = F.min(F.when(F.col("n_le") >= F.floor(place) + 1, F.col("v")))
        high = F.min(F.when(F.col("n_le") >= F.floor(place) + 2, F.col("v")))
        parts.append((low, F.coalesce(high, low), F.max(place - F.floor(place))))
    low, high = (a + share * (b - a) for a, b, share in parts)
    return values.groupBy(*groups).agg((TOLERANCE * (high - low)).alias("_tol"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("_mean"))


def _numbered(known: DataFrame, groups: list[str]) -> DataFrame:
    """groups, x, w, wy, r, u: distinct values, their rows and sum of ys, their number from 1, and how many there are."""
    spread = step(_spread(cumulative(known, "x", groups), groups), "spread")
    near = beside(known, spread, groups).where("_tol > 0").withColumn("_key", F.rint((F.col("x") - F.col("_mean")) / F.col("_tol")))
    values = near.groupBy(*groups, "_key").agg(F.min("x").alias("x"), F.count("*").alias("w"), F.sum("y").alias("wy"))
    sums = cumulative(values, "x", groups, {"n": F.col("w"), "wy": F.col("wy")})
    return step(sums.where(F.col("d_all") >= VALUES).select(*groups, F.col("v").alias("x"), F.col("n").alias("w"), "wy", F.col("d_le").alias("r"), F.col("d_all").alias("u")), "values")


def _places() -> tuple[Column, Column, Column]:
    """Of a value numbered r of u: the last knot at or before it, whether it is that knot, and the number of knots. Knots
    are evenly spaced numbers, rounded down, so no value needs the list of them."""
    r, u = F.col("r"), F.col("u")
    m = knots_of(u)
    width = (u - 1).cast("double") / (m - 1)
    number = lambda i: F.when(i >= m - 1, u).otherwise(F.floor(i * width + 1.0))
    near = F.floor((r - 1) / width)
    last = F.least(F.when(number(near + 1) <= r, near + 1).when(number(near) <= r, near).otherwise(near - 1), m - 1)
    return last, number(last) == r, m


def _basis(z: Column, t: list[Column]) -> list[Column]:
    """The four cubic B-splines at z, between the third and the fourth of six knots."""
    own: list[Column] = [F.lit(1.0)]
    for d in (1, 2, 3):
        saved, above = F.lit(0.0), []
        for k in range(d):
            low, high = t[3 + k - d], t[3 + k]
            share = own[k] / (high - low)
            above.append(saved + (high - z) * share)
            saved = (z - low) * share
        own = [*above, saved]
    return own


def _basis_polynomials(t: np.ndarray) -> np.ndarray:
    """The same four as polynomials of the distance from the third knot: a row each, rising powers."""
    own = np.array([[1.0, 0.0, 0.0, 0.0]])
    times = lambda p: np.concatenate([[0.0], p[:-1]])
    for d in (1, 2, 3):
        above = np.zeros((d + 1, 4))
        for k in range(d):
            low, high = t[3 + k - d], t[3 + k]
            share = own[k] / (high - low)
            above[k] += (high - t[2]) * share - times(share)
            above[k + 1] += times(share) - (low - t[2]) * share
        own = above
    return own


_UPPER = [(a, b) for a in range(4) for b in range(a, 4)]


def _solved(own: pd.DataFrame) -> np.ndarray:
    """at_x, a, b, c, d of each interval from the intervals' sums: the penalised least squares of the coefficients."""
    own = own.sort_values("i")
    n = len(own) + 3
    fit, rough, right = np.zeros((n, n)), np.zeros((n, n)), np.zeros(n)
    shapes = []
    for k, (_, row) in enumerate(own.iterrows()):
        t = np.asarray(row["t"], float)
        p, h = _basis_polynomials(t), t[3] - t[2]
        c, d = p[:, 2], p[:, 3]
        shapes.append(p)
        rough[k : k + 4, k : k + 4] += 4 * h * np.outer(c, c) + 6 * h * h * (np.outer(c, d) + np.outer(d, c)) + 12 * h**3 * np.outer(d, d)
        for a, b in _UPPER:
            fit[k + a, k + b] += row[f"g{a}{b}"]
        right[k : k + 4] += [row[f"y{a}"] for a in range(4)]
    fit += np.triu(fit, 1).T
    inner = slice(2, n - 3)
    weight = np.trace(fit[inner, inner]) / np.trace(rough[inner, inner]) * 16.0 ** (6 * float(own["_spar"].iloc[0]) - 2)
    coefficients = np.linalg.solve(fit + weight * rough, right)
    scale = float(own["_range"].iloc[0]) ** -np.arange(4.0)
    return np.array([[row_x, *(coefficients[k : k + 4] @ p * scale)] for k, (row_x, p) in enumerate(zip(own["at_x"], shapes, strict=True))])


def smoothing_spline(df: DataFrame, x: str, y: str, groups: list[str] = (), spar: float | DataFrame = 0.5) -> DataFrame:
    """groups and the PIECEs of each group's cubic smoothing spline of y on x; the first reaches back to -inf, the last on
    to inf. spar, a number or a table of groups and _spar, sets the penalty: 16 ** (6 * spar - 2) times the ratio of the
    traces of fit and roughness. Values closer than TOLERANCE interquartile ranges are one, at the mean of their ys,
    weighted by their rows.

    Rows are added up by interval between knots: ten products of the four B-splines that reach there and four with y. Only
    these sums, of at most knots_of(values) intervals (451 at 10 ** 12), meet in a group's task. Rows without a finite x and
    y are left out; a group of fewer than VALUES values, or without an interquartile range, has no spline and gives no row,
    as an empty table does."""
    groups = list(groups)
    rows = df.select(*groups, col(x).alias("x"), col(y).alias("y"))
    values = _numbered(step(rows.where(finite("x") & finite("y")), "known"), groups)
    last, is_knot, m = _places()
    placed = step(values.select("*", last.alias("_k"), is_knot.alias("_knot"), m.alias("_m")), "placed")
    whole = Window.partitionBy(*[F.col(g) for g in groups])  # knots, not rows
    knots = placed.where("_knot").select(*groups, F.col("_k").alias("i"), "x", "_m").withColumns({"_x0": F.min("x").over(whole), "_range": F.max("x").over(whole) - F.min("x").over(whole)})
    scaled, ordered = (F.col("x") - F.col("_x0")) / F.col("_range"), whole.orderBy("i")
    near = [F.coalesce(F.lag(scaled, -k).over(ordered), F.lit(0.0 if k < 0 else 1.0)) for k in range(-2, 4)]
    spans = knots.select(*groups, "i", "_m", F.col("x").alias("at_x"), "_x0", "_range", F.array(*near).alias("t")).where(F.col("i") < F.col("_m") - 1)
    spans = beside(spans, spar, groups) if isinstance(spar, DataFrame) else spans.withColumn("_spar", F.lit(float(spar)))
    spans = step(spans.drop("_m"), "spans")
    keys = [*groups, "i"]
    met = beside(placed.withColumn("i", F.least(F.col("_k"), F.col("_m") - 2)).select(*keys, "x", "w", "wy"), spans, keys)
    z = (F.col("x") - F.col("_x0")) / F.col("_range")
    met = met.select(*keys, "w", "wy", *[b.alias(f"b{a}") for a, b in enumerate(_basis(z, [F.col("t")[k] for k in range(6)]))])
    sums = met.groupBy(*keys).agg(*[F.sum(F.col("w") * F.col(f"b{a}") * F.col(f"b{b}")).alias(f"g{a}{b}") for a, b in _UPPER], *[F.sum(F.col("wy") * F.col(f"b{a}")).alias(f"y{a}") for a in range(4)])

    def run(key, own: pd.DataFrame) -> pd.DataFrame:
        found = _solved(own)
        starts = np.r_[-math.inf, found[1:, 0]]
        return pd.DataFrame([(*key, *map(float, (s, *r))) for s, r in zip(starts, found, strict=True)], columns=[*groups, *PIECE])

    kinds = dict(df.dtypes)
    fields = "".join(f"`{g}` {kinds[g]}, " for g in groups) + ", ".join(f"{c} double" for c in PIECE)
    return beside(sums, spans, keys).groupBy(*groups).applyInPandas(run, fields)


def score_pieces(points: DataFrame, x: str, model: DataFrame, groups: list[str] = ()) -> DataFrame:
    """points with estimate and slope, the value and the derivative of their group's pieces at x; NULL where the group has
    none or x is NULL. A group's pieces, few whatever its rows, are one sorted array."""
    groups = list(groups)
    keyed = model.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(F.sort_array(F.collect_list(F.struct(*PIECE))).alias("_s"))
    out = points.join(keyed if groups else F.broadcast(keyed), same(groups, [f"_g_{g}" for g in groups]), "left")
    own = F.try_element_at(F.filter("_s", lambda s: s["start"] <= col(x)), F.lit(-1))
    u, s = col(x) - F.col("_s.at_x"), lambda c: F.col(f"_s.{c}")
    value, slope = s("a") + u * (s("b") + u * (s("c") + u * s("d"))), s("b") + u * (2 * s("c") + u * 3 * s("d"))
    return out.withColumn("_s", own).withColumns({"estimate": value, "slope": slope}).drop("_s", *[f"_g_{g}" for g in groups])
