"""Cells of x and y split level by level, and the dependence measured within them: no group meets in one task."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailwise.functions.expr import col, correlation, safe_ratio
from tailwise.kernels import stats
from tailwise.operators.central import SORTED, gravity, gravity_of
from tailwise.operators.cumulative import SPLIT, beside, cumulative
from tailwise.operators.quantile import lpm_var
from tailwise.sources.staging import step

#: Rows of a cell that is not split any more.
LEAST = 8
#: Levels whose tables of cells the rows meet on the way before they are written again.
LEVELS = 4
#: Once no cell has more rows than this, each goes down its further levels in one task, whatever the group's size.
LOCAL = SPLIT


def _logs(n: Column) -> tuple[Column, Column]:
    """The binary logarithm of a whole number, rounded down and up, from its digits."""
    low = F.length(F.bin(n)) - 1
    return low, low + F.when(n.bitwiseAND(n - 1) != 0, 1).otherwise(0)


def _times(rows: DataFrame) -> Column:
    """How often each row stands there."""
    return F.col("_times") if "_times" in rows.columns else F.lit(1).cast("long")


def _merged(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Rows equal in x and y, which share every cell, as one, with their number _times."""
    return rows.groupBy(*groups, "x", "y").agg(F.sum(_times(rows)).alias("_times"))


def _centre_of(rows: DataFrame, column: str, keys: list[str], how: str) -> DataFrame:
    """keys, _centre of the column in each cell: its gravity (off), mean or median."""
    if how == "mean":
        return rows.groupBy(*keys).agg(F.avg(column).alias("_centre"))
    if how == "median":
        return lpm_var(rows, column, 0.5, 0, keys).withColumnRenamed("var", "_centre")
    return gravity(rows, column, keys, times="_times" if "_times" in rows.columns else None).withColumnRenamed("gravity", "_centre")


def _centres(rows: DataFrame, keys: list[str], how: str, sides: str = "xy") -> DataFrame:
    """keys, _cx and _cy (those of sides) of each cell. Gravities of both are found side by side, as groups of one table."""
    if how != "off" or len(sides) == 1:
        at = [_centre_of(rows, c, keys, how).withColumnRenamed("_centre", f"_c{c}") for c in sides]
        return at[0] if len(at) == 1 else beside(*at, keys)
    both = F.array(*[F.struct(F.lit(c).alias("_side"), F.col(c).alias("_v")) for c in sides])
    long = rows.select(*keys, _times(rows).alias("_times"), F.explode(both).alias("_r")).select(*keys, "_times", "_r.*")
    at = gravity(long, "_v", [*keys, "_side"], times="_times")
    at = at.groupBy(*keys).agg(*[F.max(F.when(F.col("_side") == c, F.col("gravity"))).alias(f"_c{c}") for c in sides])
    return at.dropna(subset=[f"_c{c}" for c in sides])


def _below(stop: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A cell's rows with the digits of its further levels, and the level at which it would stop its group."""

    def go(own: pd.DataFrame) -> pd.DataFrame:
        digits, last = stats.levels(own["x"].to_numpy(), own["y"].to_numpy(), own["_times"].to_numpy(), int(own["_left"].iloc[0]), int(own["_bound"].iloc[0]), stop)
        return own.drop(columns=["_left", "_bound"]).assign(_digits=digits, _last=last)

    return go


def _finished(rows: DataFrame, at: DataFrame, groups: list[str], stop: bool) -> DataFrame:
    """rows with the cells of at (keys, _left levels, _bound) split to the end, side by side, each in one task. With stop, a
    group's levels end with the first that leaves any of its cells with few rows: digits below that are cut off."""
    keys = [*groups, "_cell"]
    met = rows.withColumn("_times", _times(rows)).join(at.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_left", "_bound"), _same(keys), "left").drop(*[f"_k_{k}" for k in keys])
    inner, rest = met.where(F.col("_left").isNotNull()), met.where(F.col("_left").isNull()).drop("_left", "_bound")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    split_ = inner.groupBy(*keys).applyInPandas(_below(stop), f"{kind}, _digits string, _last int")
    if stop:
        split_ = step(split_, "levels")
        ends = split_.groupBy(*groups).agg(F.min("_last").alias("_last"))
        split_ = beside(split_.drop("_last"), step(ends, "ends"), groups).withColumn("_digits", F.expr("substring(_digits, 1, _last)"))
    label, far = F.concat("_cell", "_digits"), F.length("_digits") > 0
    split_ = split_.select(*[c for c in rest.columns if c not in ("_cell", "_prior")], label.alias("_cell"), F.when(far, label.substr(F.lit(1), F.length(label) - 1)).otherwise(F.col("_prior")).alias("_prior"))
    both = split_.unionByName(rest)
    return both if "_times" in rows.columns else both.drop("_times")


def split(rows: DataFrame, groups: list[str], x_only: bool = False, order: int | DataFrame | None = None, least: Column | int = LEAST, stop: bool = True, centre: str = "off", constants: bool = True) -> DataFrame:
    """rows (groups, x, y, and where centres are gravities _times, from _merged) with _cell and _prior, the cell before its last split. Each level splits the cells with more
    than least rows (a number, or a column of the group's rows n) at their centre, until a group has reached its depth
    (order, or each group's in a table of groups and _order), or, with stop, has a cell of least rows or fewer; without constants, cells with one x are left as they are.

    A level is an aggregate of the cells, which is written; the rows meet the tables of split cells on their next way, and
    are written every LEVELS levels, so plans stay small and lost executors cost little. Cells of x alone, split at
    gravities, are intervals of it: its distinct values are sorted once, and every level only adds up intervals. Cells of x
    and y, split at gravities, go down their further levels in a task each once none has more than LOCAL rows."""
    keys, sides = [*groups, "_cell"], "x" if x_only else "xy"
    start = [F.lit("q").alias("_cell"), F.lit("pq").alias("_prior")]
    own = step(rows.select(*groups, "x", "y", *[c for c in rows.columns if c == "_times"], *start), "rows")
    values = None
    if x_only and centre == "off":
        values = step(cumulative(own, "x", groups, {"n": _times(own)}).select(*groups, F.col("v").alias("x"), "c", "n", "n_le", *start), "values")
    means = [_mean(c).alias(f"_c{c}") for c in sides if centre == "mean"]
    local = centre == "off" and not x_only and constants
    depth = 0
    while True:
        held, count, facts = (own, F.sum(_times(own)), means) if values is None else (values, F.sum("n"), _interval())
        cells = held.groupBy(*keys).agg(count.alias("_rows"), F.count("*").alias("_held"), (F.min("x") < F.max("x")).alias("_wide"), *facts)
        whole = Window.partitionBy(*[F.col(g) for g in groups])
        cells = cells.withColumns({"n": F.sum("_rows").over(whole), "_smallest": F.min("_rows").over(whole)})
        if isinstance(order, DataFrame):
            cells = beside(cells, order, groups)
        low, high = _logs(F.col("n"))
        wanted = F.col("_order") if isinstance(order, DataFrame) else high if order is None else F.lit(order)
        bound = least if isinstance(least, Column) else F.lit(least)
        deepest = F.least(F.greatest(F.lit(1), wanted), low)
        ready = (F.lit(depth) < deepest) & (F.col("_rows") > bound)
        if stop and depth:
            ready = ready & (F.col("_smallest") > bound)
        if not constants:
            ready = ready & F.col("_wide")
        cells = cells.withColumns({"_left": (deepest - depth).cast("int"), "_bound": bound.cast("long")})
        at = step(cells.where(ready).drop("_rows", "_wide", "n", "_smallest", "_order"), "cells")
        most = at.agg(F.max("_held")).first()[0]
        if most is None:
            return own
        if local and most <= LOCAL:
            return _finished(own, at, groups, stop)
        at = at.drop("_held", "_left", "_bound")
        if values is not None:
            met = values.where(F.abs("x") < float("inf")).join(at.withColumnsRenamed({k: f"_k_{k}" for k in keys}), _same(keys))
            sorted_ = met.select(*keys, F.col("x").alias("v"), "c", "n", (F.col("n_le") - F.col("_before")).alias("n_le"), "n_all", "s1_all")
            at = step(gravity_of(sorted_.select(*keys, *SORTED), keys).withColumnRenamed("gravity", "_cx"), "centres")
        elif not means:
            inside = own.join(at.withColumnsRenamed({k: f"_k_{k}" for k in keys}), _same(keys), "left_semi")
            at = step(_centres(inside, keys, centre, sides), "centres")
        own = _routed(own, at, keys, x_only)
        values = None if values is None else _routed(values, at, keys, x_only)
        depth += 1
        if depth % LEVELS == 0:
            own = step(own, "rows")
            values = None if values is None else step(values, "values")


def _mean(c: str, times: Column | None = None) -> Column:
    """The mean, rounded once, in whatever order rows are added: a row on its cell's mean is not put beyond it. Short
    numbers add up exactly (about 2 ** 29 of them); what they leave of the values is small, and so is what its sum loses."""
    short = lambda v: v.cast("float").cast("double")
    k = F.lit(1.0) if times is None else times.cast("double")
    n, high, low = F.sum(F.when(F.col(c).isNotNull(), k)), F.sum(k * short(F.col(c))), F.sum(k * (F.col(c) - short(F.col(c))))
    near = short((high + low) / n)
    return F.when(F.abs(high) < float("inf"), near + ((high - n * near) + low) / n).otherwise(F.sum(k * F.col(c)) / n)


def _interval() -> list[Column]:
    """Of an interval of distinct values: finite values before it, in it, and the sum of their distances from c."""
    finite = lambda v: F.when(F.abs("x") < float("inf"), v)
    return [F.min(finite(F.col("n_le") - F.col("n"))).alias("_before"), F.sum(finite(F.col("n"))).alias("n_all"), F.sum(finite(F.col("n") * (F.col("x") - F.col("c")))).alias("s1_all")]


def _routed(rows: DataFrame, at: DataFrame, keys: list[str], x_only: bool) -> DataFrame:
    """rows in the cells below those that at gives a centre; the others stay where they are."""
    kept = [c for c in rows.columns if c not in ("_cell", "_prior")]
    met = rows.join(at.withColumnsRenamed({k: f"_k_{k}" for k in keys}), _same(keys), "left")
    digit = F.when(F.col("x") > F.col("_cx"), 2).otherwise(1)
    if not x_only:
        digit = 1 + (F.col("x") <= F.col("_cx")).cast("int") + 2 * (F.col("y") <= F.col("_cy")).cast("int")
    stays = F.col("_cx").isNull()
    return met.select(*kept, F.when(stays, F.col("_cell")).otherwise(F.concat("_cell", digit.cast("string"))).alias("_cell"), F.when(stays, F.col("_prior")).otherwise(F.col("_cell")).alias("_prior"))


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return out


def _pairs_of(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    return df.select(*groups, col(x).alias("x"), col(y).alias("y")).dropna(subset=["x", "y"])


def partition(df: DataFrame, x: str, y: str, groups: list[str], points: bool = False, x_only: bool = False, order: int | DataFrame | None = None, least: int = LEAST, stop: bool = True, centre: str = "off") -> DataFrame:
    """groups, x, y, quadrant, prior of each row, or the regression points: groups, prior, x, y, the centres of the rows by
    their prior quadrant, whole numbers where the group's xs all are. Rows without an x or y are left out."""
    rows = _pairs_of(df, x, y, groups)
    own = split(_merged(rows, groups) if points and centre == "off" else rows, list(groups), x_only, order, least, stop, centre)
    if not points:
        return own.select(*groups, "x", "y", F.col("_cell").alias("quadrant"), F.col("_prior").alias("prior"))
    own, keys = step(own, "rows"), [*groups, "_prior"]
    at = _centres(own, keys, centre)
    whole = own.groupBy(*groups).agg(F.bool_and(F.col("x") == F.floor("x")).alias("_whole"))
    at = beside(at, whole, groups)
    return at.select(*groups, F.col("_prior").alias("prior"), F.when(F.col("_whole"), F.floor(F.col("_cx") + 0.5).cast("double")).otherwise(F.col("_cx")).alias("x"), F.col("_cy").alias("y"))


def _concordance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, size, and around the cell's means: co0 and co1, the concordant share of rows and of |products|, d0 and d1, the
    discordant ones (where not both are strictly on one side), slope, the sum of products."""
    times = _times(rows)
    mean = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(_mean(c, times))
    met = beside(rows, rows.groupBy(*keys).agg(mean("x").alias("_mx"), mean("y").alias("_my")), keys)
    a, b = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    p = a * b
    apart = ~(((a < 0) & (b < 0)) | ((a > 0) & (b > 0)))
    share = lambda test: F.sum(F.when(test, times).otherwise(0)) / F.sum(times)
    mass = lambda test: F.coalesce(safe_ratio(F.sum(F.when(test, times * F.abs(p)).otherwise(0.0)), F.sum(times * F.abs(p))), F.lit(0.0))
    return met.groupBy(*keys).agg(F.sum(times).alias("size"), share(((a > 0) & (b > 0)) | ((a <= 0) & (b <= 0))).alias("co0"), mass(p > 0).alias("co1"), share(apart).alias("d0"), mass(apart).alias("d1"), F.sum(times * p).alias("slope"))


def _signed_copula() -> Column:
    away = lambda c, free: F.abs(F.col(c) - free) / free
    size = F.sqrt((F.least(away("co0", 0.5), F.lit(1.0)) + F.least(away("co1", 0.5), F.lit(1.0)) + away("d0", 0.75) + away("d1", 0.75)) / 4)
    return F.when(F.col("size") < 2, 0.0).when(F.col("co0").isin(0.0, 1.0), 1.0).otherwise(size * F.signum("slope"))


def centred(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _mx, _my, _r: the means of merged rows and their absolute correlation, NULL where a column is constant."""
    mean = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(_mean(c, F.col("_times")))
    means = step(rows.groupBy(*keys).agg(mean("x").alias("_mx"), mean("y").alias("_my")), "means")
    a, b, times = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my"), F.col("_times")
    r = F.abs(F.try_divide(F.sum(times * a * b), F.sqrt(F.sum(times * a * a)) * F.sqrt(F.sum(times * b * b))))
    return beside(rows, means, keys).groupBy(*keys).agg(F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), r.alias("_r"))


def ways(df: DataFrame, x: str, y: str, groups: list[str] = (), asym: bool = False, merged: bool = False) -> DataFrame:
    """groups, _way, correlation, dependence: the mean signed and absolute copula of the cells of x (_way 0) and, unless
    asym, of y (1), weighted by rows. Both ways are split side by side, as groups of one table. 0 and 0 where x or y is
    constant; columns of few values take their discrete copula in. Rows without an x or y are left out. merged: df is a written table
    of groups, x, y and _times, how often a row stands there."""
    groups = list(groups)
    rows = df if merged else step(_merged(_pairs_of(df, x, y, groups), groups), "pairs")
    both = [F.struct(F.lit(0).alias("_way"), "x", "y", "_times")] + [F.struct(F.lit(1).alias("_way"), F.col("y").alias("x"), F.col("x").alias("y"), "_times")] * (not asym)
    both = rows.select(*groups, F.explode(F.array(*both)).alias("_r")).select(*groups, "_r.*")
    own = split(both, [*groups, "_way"], True, None, F.greatest(F.lit(LEAST), F.floor(F.col("n") / LEAST)), False, "off", False)
    cells = _concordance(step(own, "rows"), [*groups, "_way", "_cell"]).withColumn("_v", _signed_copula())
    mean = lambda v: F.sum(v * F.col("size")) / F.sum("size")
    each = cells.groupBy(*groups, "_way").agg(mean(F.col("_v")).alias("correlation"), mean(F.abs("_v")).alias("dependence"))
    facts = rows.groupBy(*groups).agg(F.sum("_times").alias("_n"), *[F.count_distinct(c).alias(f"_d{c}") for c in "xy"])
    discrete = _concordance(rows.withColumn("_one", F.lit(1)), [*groups, "_one"]).select(*groups, "co0", "d0")
    each = beside(each, step(beside(facts, discrete, groups), "facts"), groups)
    few = (F.col("_dx") < F.sqrt("_n")) & (F.col("_dy") < F.sqrt("_n"))
    rough = F.sqrt((F.least(F.abs(F.col("co0") - 0.5) * 2, F.lit(1.0)) + F.abs(F.col("d0") - 0.75) / 0.75) / 2)
    flat = (F.col("_dx") == 1) | (F.col("_dy") == 1)
    value = F.when(few, (F.col("dependence") + rough) / 2).otherwise(F.col("dependence"))
    return each.select(*groups, "_way", F.when(flat, 0.0).otherwise(F.col("correlation")).alias("correlation"), F.when(flat, 0.0).otherwise(value).alias("dependence"))


def dependence(df: DataFrame, x: str, y: str, groups: list[str] = (), asym: bool = False) -> DataFrame:
    """groups, correlation, dependence: that of the cells of x, unless asym that of the cells of y where it is larger."""
    return ways(df, x, y, groups, asym).groupBy(*groups).agg(F.max("correlation").alias("correlation"), F.max("dependence").alias("dependence"))


def pair_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, value: the dependence of each pair of columns, all pairs split side by side."""
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), col(a).alias("x"), col(b).alias("y")) for a, b in itertools.combinations(columns, 2)])
    rows = df.select(F.explode(cells).alias("c")).select("c.*")
    return dependence(rows, "x", "y", ["a", "b"]).select("a", "b", F.col("dependence").alias("value"))


#: Columns from which a norm weights by dependence instead of correlation.
MANY = 10


def norm_scales(df: DataFrame, columns: list[str], linear: bool = False) -> DataFrame:
    """column, scale: the factor of each column that brings them to a common scale, the mean over all columns of the ratio
    of their means, weighted unless linear by |correlation|, from MANY columns on by dependence (a column's own weight is
    1). A mean of 0 counts as 1e-10. Rows that lack a column are left out."""
    df = df.select(*[col(c).alias(c) for c in columns]).dropna()
    if linear or len(columns) < MANY:
        cells = [] if linear else [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.abs(correlation(a, b)), F.lit(float("nan"))).alias("value")) for a, b in itertools.combinations(columns, 2)]
        wide = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(c).alias("m")) for c in columns]).alias("m"), (F.array(*cells) if cells else F.lit(None)).alias("w"))
        means = wide.select(F.explode("m").alias("c")).select("c.*")
        pairs = wide.select(F.explode("w").alias("c")).select("c.*") if cells else None
    else:
        means = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(c).alias("m")) for c in columns]).alias("m")).select(F.explode("m").alias("c")).select("c.*")
        pairs = pair_matrix(df, columns)
    means = means.withColumn("m", F.when(F.col("m") == 0, 1e-10).otherwise(F.col("m")))
    other = means.select(F.col("column").alias("other"), F.col("m").alias("_m"))
    met = means.join(F.broadcast(other), F.lit(True) if linear else F.col("column") != F.col("other"))  # columns are few
    if linear:
        total = met.groupBy("column").agg(F.sum(F.col("_m") / F.col("m")).alias("t"))
        return total.select("column", (F.col("t") / len(columns)).alias("scale"))
    turned = pairs.select(F.explode(F.array(F.struct("a", "b", "value"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "value"))).alias("c")).select("c.*")
    met = met.join(turned, (F.col("column") == F.col("a")) & (F.col("other") == F.col("b")))
    total = met.groupBy("column").agg(F.sum(F.col("_m") / F.col("m") * F.col("value")).alias("t"))
    return total.select("column", ((F.col("t") + 1) / len(columns)).alias("scale"))
