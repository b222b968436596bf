"""Univariate, joint and classical partial moments of groups, as two aggregations at most."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailwise.functions.expr import col, complete, lower_dev, lpm, lpm_ratio, safe_ratio, upm, upm_ratio, upper_dev

#: Groups up to this many are sent to all tasks when rows need their group's mean; else the join shuffles.
BROADCAST_GROUPS = 100_000
#: Columns from which matrices are made of products in batches rather than of an expression a cell.
WIDE = 16


def with_group_means(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """df with mean_<column> of the row's group beside it."""
    means = df.groupBy(*groups).agg(*[F.avg(col(c)).alias(f"mean_{c}") for c in columns])
    if not groups:
        return df.join(F.broadcast(means))
    means = means.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    few = means.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    on = [df[g].eqNullSafe(means[f"_g_{g}"]) for g in groups]
    return df.join(F.broadcast(means) if few else means, on).drop(*[f"_g_{g}" for g in groups])


def partial_moments(df: DataFrame, column: str, degrees: list[float], groups: list[str] = (), target=None) -> DataFrame:
    """lpm_d, upm_d, lpm_ratio_d and upm_ratio_d for each degree; target None means the group's mean, a Column
    may be a moving target."""
    if target is None:
        df = with_group_means(df, [column], list(groups))
        target = F.col(f"mean_{column}")
    out = []
    for d in degrees:
        n = f"{d:g}".replace(".", "_")
        out += [lpm(column, target, d).alias(f"lpm{n}"), upm(column, target, d).alias(f"upm{n}"), lpm_ratio(column, target, d).alias(f"lpm_ratio{n}"), upm_ratio(column, target, d).alias(f"upm_ratio{n}")]
    return df.groupBy(*groups).agg(*out)


def ratios_at(df: DataFrame, column: str, targets: list[float], degree: float, groups: list[str] = ()) -> DataFrame:
    """A row per group and target, from one aggregation with an expression per target."""
    aggs = [F.struct(F.lit(float(t)).alias("target"), lpm(column, t, degree).alias("lpm"), upm(column, t, degree).alias("upm"), lpm_ratio(column, t, degree).alias("ratio")) for t in targets]
    wide = df.groupBy(*groups).agg(F.array(*aggs).alias("_r"))
    return wide.select(*groups, F.explode("_r").alias("_r")).select(*groups, "_r.*")


def moments(df: DataFrame, column: str, groups: list[str] = (), population: bool = True) -> DataFrame:
    """mean, variance, skewness, kurtosis (excess) from the partial moments around the mean."""
    x = col(column)
    df = with_group_means(df, [column], list(groups))
    m = F.col(f"mean_{column}")
    side = lambda d: (upm(column, m, d), lpm(column, m, d))
    (u2, l2), (u3, l3), (u4, l4) = side(2), side(3), side(4)
    base = df.groupBy(*groups).agg(F.avg(x).alias("mean"), (u2 + l2).alias("v"), (u3 - l3).alias("s"), (u4 + l4).alias("k"), F.count(x).cast("double").alias("n"))
    n, v, s, k = (F.col(c) for c in "nvsk")
    if population:
        skew, kurt, var = safe_ratio(s, F.pow(v, 1.5)), safe_ratio(k, v * v) - 3, v
    else:
        skew = safe_ratio(n, (n - 1) * (n - 2)) * safe_ratio(n * s, F.pow(v, 1.5))
        adjusted = v * safe_ratio(n, n - 1)
        kurt = safe_ratio(n * (n + 1), (n - 1) * (n - 2) * (n - 3)) * safe_ratio(n * k, adjusted * adjusted) - safe_ratio(3 * (n - 1) * (n - 1), (n - 2) * (n - 3))
        var = adjusted
    return base.select(*groups, "mean", var.alias("variance"), skew.alias("skewness"), kurt.alias("kurtosis"))


def co_moments(df: DataFrame, x: str, y: str, degree_lpm: float, degree_upm: float, groups: list[str] = (), target_x=None, target_y=None, degree_y: float | None = None) -> DataFrame:
    """clpm, cupm, dlpm (x above, y below) and dupm (x below, y above); targets default to the group's means. degree_y is
    y's degree in clpm and cupm where it isn't x's. Rows without an x or y count nowhere, nor in the means."""
    df = complete(df, [x, y])
    if target_x is None or target_y is None:
        df = with_group_means(df, [x, y], list(groups))
    tx = F.col(f"mean_{x}") if target_x is None else target_x
    ty = F.col(f"mean_{y}") if target_y is None else target_y
    lx, ly, ux, uy = lower_dev(x, tx, degree_lpm), lower_dev(y, ty, degree_lpm), upper_dev(x, tx, degree_upm), upper_dev(y, ty, degree_upm)
    own_l, own_u = (ly, uy) if degree_y is None else (lower_dev(y, ty, degree_y), upper_dev(y, ty, degree_y))
    return df.groupBy(*groups).agg(F.avg(lx * own_l).alias("clpm"), F.avg(ux * own_u).alias("cupm"), F.avg(ux * ly).alias("dlpm"), F.avg(lx * uy).alias("dupm"))


def nd_terms(columns: list[str], targets: list[Column], degree: float) -> tuple[Column, Column, Column]:
    """Row terms of the d-dimensional lower, upper (both inclusive) and discordant moments; NULL where a column or target
    is."""
    diff = [col(c) - t for c, t in zip(columns, targets, strict=True)]
    every = lambda tests: _all(list(tests))
    product = F.lit(1.0)
    for d in diff:
        product = product * (F.lit(1.0) if degree == 0 else F.pow(F.abs(d), F.lit(float(degree))))
    known = every(d.isNotNull() for d in diff)
    low = F.when(every(d <= 0 for d in diff), product).when(known, 0.0)
    high = F.when(every(d >= 0 for d in diff), product).when(known, 0.0)
    discordant = F.when(every(d < 0 for d in diff) | every(d > 0 for d in diff), 0.0).when(known, product)
    return low, high, discordant


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def co_moments_nd(df: DataFrame, columns: list[str], degree: float, groups: list[str] = (), norm: bool = True, targets: list | None = None) -> DataFrame:
    """co_lpm_nd, co_upm_nd, dpm_nd around targets (numbers or columns), the group's means by default; norm divides
    degrees above 0 by their sum. Rows that lack a column count nowhere."""
    df = complete(df, columns)
    if targets is None:
        df = with_group_means(df, columns, list(groups))
        targets = [F.col(f"mean_{c}") for c in columns]
    low, high, other = (F.avg(t) for t in nd_terms(columns, [t if isinstance(t, Column) else F.lit(float(t)) for t in targets], degree))
    if norm and degree > 0:
        total = low + high + other
        low, high, other = (F.coalesce(safe_ratio(v, total), F.lit(0.0)) for v in (low, high, other))
    return df.groupBy(*groups).agg(low.alias("co_lpm_nd"), high.alias("co_upm_nd"), other.alias("dpm_nd"))


def _averages(df: DataFrame, low: dict, up: dict, columns: list[str], groups: list[str]) -> DataFrame:
    """An average for each cell in one code-generated aggregate; a cell and its mirror share theirs."""
    kinds = {"clpm": (low, low), "cupm": (up, up), "dlpm": (up, low)}
    aggs = [F.avg(f[a] * g[b]).alias(f"{k}|{a}|{b}") for k, (f, g) in kinds.items() for i, a in enumerate(columns) for j, b in enumerate(columns) if k == "dlpm" or i <= j]
    wide = df.groupBy(*groups).agg(F.count("*").cast("double").alias("_n"), *aggs)

    def cell(k: str, a: str, b: str) -> Column:
        if k == "dupm":
            return F.col(f"`dlpm|{b}|{a}`")
        return F.col(f"`{k}|{a}|{b}`" if k == "dlpm" or columns.index(a) <= columns.index(b) else f"`{k}|{b}|{a}`")

    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), *[cell(k, a, b).alias(k) for k in ("clpm", "cupm", "dlpm", "dupm")]) for a in columns for b in columns]))
    return wide.select(*groups, "_n", cells.alias("_c")).select(*groups, "_n", "_c.*")


def _products(df: DataFrame, low: dict, up: dict, columns: list[str], groups: list[str]) -> DataFrame:
    """The same from matrix products of each batch of rows, summed: the plan doesn't grow with the columns."""
    d, names = len(columns), [f"_g{k}" for k in range(len(groups))]
    rows = df.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], F.array(*[low[c] for c in columns]).alias("l"), F.array(*[up[c] for c in columns]).alias("u"))
    fields = "".join(f"{n} {t}, " for n, t in zip(names, (dict(df.dtypes)[g] for g in groups), strict=True))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lo, hi = (np.asarray(batch.column(len(names) + k).flatten()).reshape(n, d) for k in (0, 1))
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(names))), strict=True)) if names else [()] * n
            place: dict = {}
            own = np.array([place.setdefault(k, len(place)) for k in keys])
            for key, g in place.items():
                a, b = lo[own == g], hi[own == g]
                out = [a.T @ a, b.T @ b, b.T @ a]
                cols = [pa.array([v] * (d * d), batch.schema.field(k).type) for k, v in enumerate(key)]
                cols += [pa.array(np.repeat(np.arange(d), d), pa.int32()), pa.array(np.tile(np.arange(d), d), pa.int32()), pa.array(np.full(d * d, len(a)), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(m.ravel()) for m in out], [*names, "i", "j", "n", "clpm", "cupm", "dlpm"])

    sums = rows.mapInArrow(run, fields + "i int, j int, n long, clpm double, cupm double, dlpm double")
    each = sums.groupBy(*names, "i", "j").agg(F.sum("n").cast("double").alias("_n"), *[(F.sum(k) / F.sum("n")).alias(k) for k in ("clpm", "cupm", "dlpm")])
    mirror = each.select(*[F.col(n).alias(f"_m{n}") for n in names], F.col("i").alias("_j"), F.col("j").alias("_i"), F.col("dlpm").alias("dupm"))
    on = [F.col(n).eqNullSafe(F.col(f"_m{n}")) for n in names]
    both = each.join(mirror, [F.col("i") == F.col("_i"), F.col("j") == F.col("_j"), *on])
    label = F.array(*[F.lit(c) for c in columns])
    return both.select(*[F.col(n).alias(g) for n, g in zip(names, groups, strict=True)], "_n", F.get(label, F.col("i")).alias("row"), F.get(label, F.col("j")).alias("col"), "clpm", "cupm", "dlpm", "dupm")


def pm_matrix(df: DataFrame, columns: list[str], degree_lpm: float, degree_upm: float, pop_adj: bool = False, norm: bool = False, groups: list[str] = ()) -> DataFrame:
    """Long form of the partial-moment matrices: row and column names, clpm, cupm, dlpm, dupm, covariance. One
    pass over the data whatever the number of columns; the d * d averages become rows afterwards. Rows that lack a column
    count nowhere."""
    df = complete(df, columns)
    df = with_group_means(df, columns, list(groups))
    low = {c: lower_dev(c, F.col(f"mean_{c}"), degree_lpm) for c in columns}
    up = {c: upper_dev(c, F.col(f"mean_{c}"), degree_upm) for c in columns}
    long = _products(df, low, up, columns, list(groups)) if len(columns) > WIDE else _averages(df, low, up, columns, list(groups))
    kinds = ("clpm", "cupm", "dlpm", "dupm")
    if pop_adj and degree_lpm > 0 and degree_upm > 0:
        long = long.withColumns({k: F.when(F.col("_n") > 1, F.col(k) * F.col("_n") / (F.col("_n") - 1)).otherwise(F.col(k)) for k in kinds})
    if norm:
        total = F.col("clpm") + F.col("cupm") + F.col("dlpm") + F.col("dupm")
        long = long.withColumn("_t", total).withColumns({k: F.coalesce(safe_ratio(F.col(k), F.when(F.col("_t") > 0, F.col("_t"))), F.lit(0.0)) for k in kinds})
    return long.select(*groups, "row", "col", *kinds, (F.col("cupm") + F.col("clpm") - F.col("dupm") - F.col("dlpm")).alias("covariance"))


def copula(df: DataFrame, columns: list[str], groups: list[str] = (), continuous: bool = True) -> DataFrame:
    """Dependence in 0..1 of d columns from co-moments of degrees 0 and 1 against independence. Rows that lack a column
    count nowhere."""
    d = len(columns)
    df = complete(df, columns)
    df = with_group_means(df, columns, list(groups))
    means = {c: F.col(f"mean_{c}") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    co0, co1 = F.lit(0.0), F.lit(0.0)
    aggs = {}
    for k, (a, b) in enumerate(pairs):
        for deg in (0, 1):
            la, lb, ua, ub = (f(c, means[c], deg) for f, c in ((lower_dev, a), (lower_dev, b), (upper_dev, a), (upper_dev, b)))
            aggs[f"_co{deg}_{k}"] = F.avg(la * lb + ua * ub)
            aggs[f"_all{deg}_{k}"] = F.avg((la + ua) * (lb + ub))
        co0 = co0 + F.col(f"_co0_{k}")
        co1 = co1 + F.coalesce(safe_ratio(F.col(f"_co1_{k}"), F.col(f"_all1_{k}")), F.lit(0.0))
    for deg in (0, 1):
        low, high, other = nd_terms(columns, [means[c] for c in columns], deg)
        aggs |= {f"_l{deg}": F.avg(low), f"_h{deg}": F.avg(high), f"_d{deg}": F.avg(other)}
    base = df.groupBy(*groups).agg(*[v.alias(k) for k, v in aggs.items()])
    free_co, free_d = 0.25 * (d * d - d), 1 - 0.5**d
    n0 = F.col("_d0")
    n1 = F.coalesce(safe_ratio(F.col("_d1"), F.col("_l1") + F.col("_h1") + F.col("_d1")), F.lit(0.0))
    clip = lambda c: F.least(F.greatest(F.abs(c - free_co) / free_co, F.lit(0.0)), F.lit(1.0))
    if not continuous:
        co1, n1 = co0, n0
    value = F.sqrt((clip(co0) + clip(co1) + F.abs(n0 - free_d) / free_d + F.abs(n1 - free_d) / free_d) / 4)
    return base.select(*groups, F.when((co0 == 0) | (co0 == 1), 1.0).otherwise(value).alias("copula"))


def downside_stress(df: DataFrame, assets: list[str], market: str, degrees: list[int], target: float = 0.0) -> DataFrame:
    """asset, degree, co_lpm of each asset with the market, both below the target, over the rows given (such as those of a
    falling market). One pass for all assets and degrees."""
    own = lambda c, k: lower_dev(c, F.lit(target), k) * lower_dev(market, F.lit(target), k)
    cells = [F.struct(F.lit(c).alias("asset"), F.lit(k).alias("degree"), F.avg(own(c, k)).alias("co_lpm")) for c in assets for k in degrees]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
