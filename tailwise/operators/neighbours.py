"""Exact k-nearest join: boxes of training rows, pruned by bounds for boxes of points, so neither side is sent whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailwise.functions.expr import col
from tailwise.kernels import series
from tailwise.operators.cumulative import beside
from tailwise.sources.staging import step

#: Rows of a box at most, and the features whose quantiles cut the space.
ROWS = 256
CUT_FEATURES = 3
#: Rows of both sides that a task gets where boxes meet: it sorts them, and AQE would join partitions by their compressed
#: size, which repeated rows keep small.
TASK_ROWS = 100_000
#: What a distance of 0 counts as.
NOTHING = 1e-10


def _boxed(rows: DataFrame, cuts: DataFrame, names: list[str], near: int) -> DataFrame:
    """rows with _box: their place among the cuts of the first features, and a part by hash where a place has too many."""
    own = names[:CUT_FEATURES]
    below = lambda k, n: F.size(F.filter(f"_cut{k}", lambda c: c < F.col(n)))
    place = F.lit(0).cast("long")
    for k, n in enumerate(own):
        place = place * (F.size(f"_cut{k}") + 1) + below(k, n)
    return _parted(rows.join(F.broadcast(cuts)).withColumn("_place", place).drop(*[f"_cut{k}" for k in range(len(own))]), near)


def _parted(rows: DataFrame, near: int) -> DataFrame:
    many = rows.groupBy("_place").agg(F.ceil(F.count("*") / near).alias("_parts"))
    return beside(rows, many, ["_place"]).withColumn("_box", F.struct("_place", F.pmod(F.xxhash64("_id"), F.col("_parts")).alias("part"))).drop("_place", "_parts")


def _boxes(rows: DataFrame, names: list[str], prefix: str) -> DataFrame:
    return rows.groupBy(F.col("_box").alias(f"{prefix}box")).agg(F.count("*").alias(f"{prefix}n"), *[f(n).alias(f"{prefix}{s}{k}") for k, n in enumerate(names) for s, f in (("lo", F.min), ("hi", F.max))])


def _size(gaps: list[Column]) -> Column:
    out = F.lit(0.0)
    for g in gaps:
        out = out + g * g + g
    return out


def nearest(train: DataFrame, points: DataFrame, features: list[str], y: str, key: str, k: int, classes: bool = False, order: str | None = None) -> DataFrame:
    """key, prediction for each point: the ys of its k nearest training rows by weight (with classes the heaviest y), the
    nearest row's y for k = 1. The distance is the sum over the features of g + g * g, where g is the gap over the range
    of the training rows and the point. Rows at one distance come by order (a column of train, else by y). Training rows
    that lack a number are left out; points that do get NULL, as all do without training rows.

    Space is cut at quantiles of the first features into boxes of ROWS rows or so, of training rows and of points. For a
    box of points, the boxes of rows that hold k rows surely within some distance bound the k-th distance of all its
    points; only boxes whose nearest corner lies within that bound are met. Both sides of a meeting have ROWS rows, and
    the meetings are dealt to as many tasks as their rows need. Equal points are looked up once."""
    names = [f"_f{j}" for j in range(len(features))]
    most = range(len(names))
    rows = train.select(*[col(f).alias(n) for f, n in zip(features, names, strict=True)], col(y).alias("_y"), (col(order) if order else F.lit(0.0)).alias("_o")).dropna()
    alike = Window.partitionBy(*names).orderBy("_o", "_y")  # beyond the first k of equal rows none is ever used
    rows = rows.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k).withColumn("_id", F.struct(*names, "_r"))
    rows = step(rows.drop("_r"), "training")
    asked = step(points.select(F.col(key).alias("_key"), *[col(f).alias(n) for f, n in zip(features, names, strict=True)]), "points")
    facts = rows.agg(F.count("*").alias("n"), *[f(n).alias(f"{s}{j}") for j, n in enumerate(names) for s, f in (("lo", F.min), ("hi", F.max))]).first()  # one row
    if not facts["n"]:
        return asked.select(F.col("_key").alias(key), F.lit(None).cast("double").alias("prediction"))
    own = names[:CUT_FEATURES]
    slices = max(1, round((facts["n"] / ROWS) ** (1 / len(own))))
    shares = [j / slices for j in range(1, slices)]
    cuts = step(rows.agg(*[(F.array_distinct(F.percentile_approx(n, shares, 10_000)) if shares else F.array().cast("array<double>")).alias(f"_cut{j}") for j, n in enumerate(own)]), "cuts")
    rows = step(_boxed(rows, cuts, names, ROWS), "training-boxes")
    known = step(asked.select(*names).dropna().distinct().withColumn("_id", F.monotonically_increasing_id()), "known")
    known = step(_boxed(known, cuts, names, ROWS), "point-boxes")

    low, high = [facts[f"lo{j}"] for j in most], [facts[f"hi{j}"] for j in most]
    range_of = lambda a, b, j: F.greatest(F.lit(high[j]), b) - F.least(F.lit(low[j]), a)
    whole = lambda c: F.when(c > 0, c).otherwise(1.0)
    c = lambda s, j: F.col(f"{s}{j}")
    met = _boxes(known, names, "q").join(_boxes(rows, names, "p"))  # boxes, of which there are rows / ROWS
    apart = [F.greatest(c("plo", j) - c("qhi", j), c("qlo", j) - c("phi", j), F.lit(0.0)) / whole(range_of(c("qlo", j), c("qhi", j), j)) for j in most]
    across = [F.greatest(c("phi", j) - c("qlo", j), c("qhi", j) - c("plo", j)) / whole(F.lit(high[j] - low[j])) for j in most]
    met = met.select("qbox", "pbox", "qn", "pn", _size(apart).alias("_least"), _size(across).alias("_most"))
    reach = Window.partitionBy("qbox")
    met = met.withColumn("_held", F.sum("pn").over(reach.orderBy("_most").rangeBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("_bound", F.min(F.when(F.col("_held") >= k, F.col("_most"))).over(reach))
    met = step(met.where(F.col("_bound").isNull() | (F.col("_least") <= F.col("_bound") * (1 + 1e-9))).select("qbox", "pbox", "qn", "pn"), "meetings")

    tasks = max(1, -(-(met.agg(F.sum(F.col("qn") + F.col("pn"))).first()[0] or 0) // TASK_ROWS))
    left = known.join(met, F.col("_box") == F.col("qbox")).select("qbox", "pbox", "_id", *names).repartition(tasks, "qbox", "pbox")
    right = rows.join(met, F.col("_box") == F.col("pbox")).select(F.col("qbox").alias("_rq"), F.col("pbox").alias("_rp"), "_y", "_o", *[F.col(n).alias(n) for n in names]).repartition(tasks, "_rq", "_rp")

    def best(_, at: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        """Each point's k nearest of a box's rows."""
        if not len(at) or not len(of):
            return pd.DataFrame({"_id": [], "d": [], "o": [], "y": []})
        of = of.sort_values(["_o", "_y"], kind="stable")
        t, x = at[names].to_numpy(), of[names].to_numpy()
        span = np.maximum(high, t) - np.minimum(low, t)
        gap = np.abs(x[None] - t[:, None]) / np.where(span > 0, span, 1.0)[:, None]
        d = (gap * gap + gap).sum(axis=2)
        d[d == 0] = NOTHING
        pick = np.argsort(d, axis=1, kind="stable")[:, :k]
        flat = pick.ravel()
        return pd.DataFrame({"_id": np.repeat(at["_id"].to_numpy(), pick.shape[1]), "d": np.take_along_axis(d, pick, axis=1).ravel(), "o": of["_o"].to_numpy()[flat], "y": of["_y"].to_numpy()[flat]})

    near = left.groupBy("qbox", "pbox").cogroup(right.groupBy("_rq", "_rp")).applyInPandas(best, "_id long, d double, o double, y double")
    near = near.groupBy("_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "o", "y"))), 1, k).alias("_n"))  # k of each box met
    weighed = F.pandas_udf(_weighed(k, classes), "double")
    found = near.select(F.col("_id").alias("_i"), weighed(F.col("_n.d"), F.col("_n.y")).alias("prediction"))
    found = known.join(found, F.col("_id") == F.col("_i")).select(*names, "prediction")
    return asked.join(found, names, "left").select(F.col("_key").alias(key), "prediction")


def _weighed(k: int, classes: bool):
    def one(d: np.ndarray, y: np.ndarray) -> float:
        if k == 1 or len(y) == 1:
            return float(y[0])
        w = series.neighbour_weights(np.asarray(d), False)
        if not classes:
            return float(y @ w)
        value, place = np.unique(y, return_inverse=True)
        return float(value[np.argmax(np.bincount(place, weights=np.ceil(100 * w)))])

    def run(d: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(np.asarray(a), np.asarray(b)) for a, b in zip(d, y, strict=True)])

    return run
