"""Partial-moment quantiles and the CDF family."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailwise.functions.expr import col, finite, safe_ratio
from tailwise.operators.cumulative import beside, cumulative, lpm_at, side_sum
from tailwise.sources.staging import step

#: Names of the CDF family's columns.
KINDS = {"CDF": "CDF", "survival": "S", "cumulative hazard": "H"}
#: Least survival whose logarithm is taken.
FLOOR = 1e-10


def _kind(ratio: Column, kind: str) -> Column:
    if kind == "CDF":
        return ratio
    return 1 - ratio if kind == "survival" else F.greatest(F.lit(0.0), -F.log(F.greatest(1 - ratio, F.lit(FLOOR))))


def _ratio_at(degree: int) -> Column:
    """The lower ratio at v; 0 where both sides are."""
    low = lpm_at(degree)
    return low if degree == 0 else F.coalesce(safe_ratio(low, low + lpm_at(degree, False)), F.when(F.col("n_all") > 0, 0.0))


def cdf(df: DataFrame, column: str, degree: int = 0, groups: list[str] = (), kind: str = "CDF") -> DataFrame:
    """groups, v, and CDF, survival or cumulative hazard at each distinct value, from ratios of an integer degree."""
    sums = cumulative(df, column, list(groups), powers=degree)
    return sums.select(*groups, "v", _kind(_ratio_at(degree), kind).alias(KINDS[kind]))


def ecdf(df: DataFrame, column: str, groups: list[str] = ()) -> DataFrame:
    return cdf(df, column, 0, groups)


def sums_at(df: DataFrame, column: str, targets: DataFrame, target: str, groups: list[str] = (), powers: int = 0) -> DataFrame:
    """cumulative's sums of df's column at each distinct target of its group: values and targets in one sort, whatever
    their numbers. targets has the group columns too; a target of a group without values has n_all 0."""
    own = df.select(*groups, col(column).alias("_v"), F.lit(1).cast("long").alias("_n"), F.lit(0).cast("long").alias("_asked"))
    asked = targets.select(*groups, col(target).alias("_v"), F.lit(0).cast("long").alias("_n"), F.lit(1).cast("long").alias("_asked"))
    return cumulative(own.unionByName(asked), "_v", list(groups), {"n": F.col("_n"), "asked": F.col("_asked")}, powers).where("asked > 0")


def partial_moments_at(df: DataFrame, column: str, targets: DataFrame, target: str, degrees: list[int], groups: list[str] = ()) -> DataFrame:
    """groups, target, and lpm_d, upm_d, lpm_ratio_d, upm_ratio_d for each integer degree at each distinct target of a
    table: one sort of values and targets, so 10^5 targets cost no more than 10^5 more rows."""
    out = []
    for d in degrees:
        low, up = lpm_at(d), lpm_at(d, False)
        share = lambda a, b, d=d: a if d == 0 else safe_ratio(a, a + b)
        out += [low.alias(f"lpm{d}"), up.alias(f"upm{d}"), share(low, up).alias(f"lpm_ratio{d}"), share(up, low).alias(f"upm_ratio{d}")]
    return sums_at(df, column, targets, target, groups, max(degrees, default=0)).select(*groups, F.col("v").alias(target), *out)


def cdf_at(df: DataFrame, column: str, targets: DataFrame, target: str, degree: int = 0, groups: list[str] = (), kind: str = "CDF") -> DataFrame:
    """groups, target, and the function's value at each distinct target; NULL outside the group's values, where it is not
    defined."""
    sums = sums_at(df, column, targets, target, groups, degree)
    inside = (F.col("n_le") > 0) & ((F.col("n_le") < F.col("n_all")) | (F.col("n") > 0))
    return sums.select(*groups, F.col("v").alias(target), F.when(inside, _kind(_ratio_at(degree), kind)).alias(KINDS[kind]))


#: Halvings of an interval of values; doubles have no more bits.
HALVINGS = 60


def _root(degree: int, p: float, row: Column) -> Column:
    """Where (1 - p) * L - p * U of the degree changes sign between u and u_after, by halving, from the power sums up to
    (<k>_le) and beyond (<k>_gt) the interval."""
    sums = {which: [row[f"{k}_{which}"] for k in _powers(degree)] for which in ("le", "gt")}

    def step(a: Column, _: Column) -> Column:
        t = (a["a"] + a["b"]) / 2
        below = (1 - p) * side_sum(degree, t, sums["le"]) - p * side_sum(degree, t, sums["gt"], False) <= 0
        return F.struct(F.when(below, t).otherwise(a["a"]).alias("a"), F.when(below, a["b"]).otherwise(t).alias("b"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(row["u"].alias("a"), row["u_after"].alias("b")), step)
    return (ends["a"] + ends["b"]) / 2


def _powers(degree: int) -> list[str]:
    return ["n", *(f"s{k}" for k in range(1, degree + 1))]


def lpm_vars(df: DataFrame, column: str, shares: dict[str, float], degree: int, groups: list[str] = ()) -> DataFrame:
    """groups, and for each name the target at which the lower ratio of the degree (1, 2, ...) is its share: one sort of
    the values for all shares. Closed forms on the located interval for degrees 1 and 2, halving beyond; all around the
    group's centre. Non-finite values are dropped."""
    groups, names = list(groups), _powers(degree)
    sums = cumulative(df.where(finite(column)), column, groups, powers=degree).withColumn("_ratio", _ratio_at(degree))
    u = lambda c: (F.col(c) - F.col("c"))
    row = F.struct(u("v").alias("u"), *[F.col(f"{k}_le") for k in names], *[(F.col(f"{k}_all") - F.col(f"{k}_le")).alias(f"{k}_gt") for k in names], u("v_after").alias("u_after"))
    at = sums.groupBy(*groups).agg(*[F.max(F.when(F.col("_ratio") <= min(max(p, 0.0), 1.0) + 1e-15, row)).alias(f"_r_{k}") for k, p in shares.items()], F.min(u("v")).alias("_low"), F.max("c").alias("_c"))

    def var(name: str, p: float) -> Column:
        p, r = min(max(p, 0.0), 1.0), F.col(f"_r_{name}")
        if degree > 2:
            value = _root(degree, p, r)
        elif degree == 1:
            value = safe_ratio((1 - p) * r["s1_le"] + p * r["s1_gt"], (1 - p) * r["n_le"] + p * r["n_gt"])
        else:
            a, b, c = (1 - p) * r["n_le"] - p * r["n_gt"], -2 * ((1 - p) * r["s1_le"] - p * r["s1_gt"]), (1 - p) * r["s2_le"] - p * r["s2_gt"]
            value = F.when(F.abs(a) < 1e-12, -safe_ratio(c, b)).otherwise(safe_ratio(-b + F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0))), 2 * a))
        return F.coalesce(F.when(r["n_gt"] == 0, r["u"]).otherwise(value), F.col("_low")) + F.col("_c")

    return at.select(*groups, *[var(k, p).alias(k) for k, p in shares.items()])


def lpm_var(df: DataFrame, column: str, p: float, degree: int, groups: list[str] = ()) -> DataFrame:
    """groups, var: the target at which the lower ratio of the degree is p; the interpolated quantile for degree 0, from
    the order statistics of sorted values, so no group's values meet in one task."""
    p = min(max(p, 0.0), 1.0)
    if degree:
        return lpm_vars(df, column, {"var": p}, degree, groups)
    rows = cumulative(df.where(finite(column)), column, list(groups))
    place = (F.col("n_all") - 1) * p
    at = lambda k: F.min(F.when(F.col("n_le") > k, F.col("v")))
    found = rows.groupBy(*groups).agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"), F.max(place - F.floor(place)).alias("f"))
    return found.select(*groups, (F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).alias("var"))


def upm_var(df: DataFrame, column: str, p: float, degree: int, groups: list[str] = ()) -> DataFrame:
    return lpm_var(df, column, 1 - p, degree, groups)


def _shifted(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


def dominated_sums(points: DataFrame, targets: DataFrame, columns: list[str], at: list[str], key: str, measures: list[str]) -> DataFrame:
    """key and, for each target (key, at), the sums of points' measures over the rows at or below it in every column;
    targets above no row have sums of 0, or no row.

    Ranks make values of all columns but the last numbers, and r < q holds for exactly one bit k that q has and r lacks,
    above which they agree. So a row joins the group (k, bits of r above k) for each bit it lacks, a target for each that
    it has, and one running sum over the last column within these groups counts what is below: rows grow by half the
    logarithm of their number for each column but the last, and no row meets a target."""
    rows = step(points.groupBy(*columns).agg(*[F.sum(m).alias(m) for m in measures]), "points")
    asked, made = targets.select(key, *at), []
    for k, (c, t) in enumerate(zip(columns[:-1], at[:-1], strict=True)):
        both = rows.select(F.col(c).alias("v")).unionByName(asked.select(F.col(t).alias("v")))
        ranks = step(cumulative(both, "v", []).select("v", F.col("d_le").alias("_r"), F.sequence(F.lit(0), F.ceil(F.log2(F.col("d_all").cast("double") + 1)).cast("int")).alias("_bits")), "ranks")
        bit, high = f"_bit{k}", f"_high{k}"
        made += [bit, high]

        def split(df: DataFrame, on: str, rank: Column, has: int, ranks=ranks, bit=bit, high=high) -> DataFrame:
            own = df.join(ranks, F.col(on) == F.col("v")).withColumn("_r", rank).drop("v")
            own = own.withColumn(bit, F.explode(F.filter("_bits", lambda b: _shifted(F.col("_r"), b) % 2 == has)))
            return step(own.withColumn(high, _shifted(F.col("_r"), F.col(bit) + 1)).drop("_r", "_bits"), "bits")

        rows, asked = split(rows, c, F.col("_r") - 1, 0), split(asked, t, F.col("_r"), 1)
    last = asked.select(*made, F.col(at[-1]).alias("_v")).withColumns({m: F.lit(0.0) for m in measures} | {"_asked": F.lit(1).cast("long")})
    own = rows.select(*made, F.col(columns[-1]).alias("_v"), *[F.col(m).cast("double").alias(m) for m in measures], F.lit(0).cast("long").alias("_asked"))
    sums = cumulative(own.unionByName(last.select(own.columns)), "_v", made, {m: F.col(m) for m in measures} | {"_asked": F.col("_asked")}).where("_asked > 0")
    found = beside(asked, sums.select(*made, F.col("v").alias(at[-1]), *[F.col(f"{m}_le").alias(m) for m in measures]), [*made, at[-1]])
    return found.groupBy(key).agg(*[F.sum(m).alias(m) for m in measures])


def cdf_nd(df: DataFrame, columns: list[str], targets: DataFrame, key: str, degree: int = 0, kind: str = "CDF") -> DataFrame:
    """key, value for each row of targets (a unique key, columns): the share of df's rows at or below it in every column,
    for an integer degree > 0 the normalised co-moment; survival and cumulative hazard follow from it and the columns' own
    ratios. Rows and targets that lack a column are left out.

    With u = target - x, a sum of products of u ** degree over the rows below in a set of columns is a polynomial of the
    target, whose coefficients are sums of the rows' monomials (around the columns' means), so everything comes from
    dominated_sums; the sum of products of |u| ** degree does too, as |u| is 2 u below and - u anywhere."""
    d, most = len(columns), range(len(columns))
    centre = df.select(*[col(c).alias(f"_x{k}") for k, c in enumerate(columns)]).dropna()
    means = centre.agg(*[F.coalesce(F.avg(f"_x{k}"), F.lit(0.0)).alias(f"_m{k}") for k in most])
    monomials = list(itertools.product(range(degree + 1), repeat=d))
    name = {e: "_e" + "_".join(map(str, e)) for e in monomials}
    points = centre.join(F.broadcast(means)).select(*[(F.col(f"_x{k}") - F.col(f"_m{k}")).alias(f"_x{k}") for k in most])
    points = step(points.withColumns({name[e]: _product([F.col(f"_x{k}") for k in most], e) for e in monomials}), "rows")
    asked = targets.select(F.col(key).alias("_k"), *[col(c).alias(f"_a{k}") for k, c in enumerate(columns)]).dropna().join(F.broadcast(means))
    asked = step(asked.select("_k", *[(F.col(f"_a{k}") - F.col(f"_m{k}")).alias(f"_a{k}") for k in most]), "targets")
    whole, singles = tuple(most), [(k,) for k in most]
    sets = {whole} | (set(singles) if kind != "CDF" else set())
    if degree % 2:
        sets |= {s for n in range(1, d) for s in itertools.combinations(most, n)}
    every = [*name.values()]
    parts = None
    for own in sorted(sets):
        label = "_s" + "_".join(map(str, own))
        found = dominated_sums(points, asked, [f"_x{k}" for k in own], [f"_a{k}" for k in own], "_k", every)
        found = found.withColumnsRenamed({m: label + m for m in every})
        parts = found if parts is None else parts.unionByName(found, True)
    sums = parts.groupBy("_k").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "_k"])
    totals = points.agg(*[F.coalesce(F.sum(m).cast("double"), F.lit(0.0)).alias("_s" + m) for m in every])
    rows = beside(asked, sums, ["_k"]).join(F.broadcast(totals))

    def over(own: tuple[int, ...], used: tuple[int, ...] = whole) -> Column:
        """Sum of the products of u ** degree of the used columns, over the rows below the target in own columns."""
        out = F.lit(0.0)
        for e in itertools.product(range(degree + 1), repeat=len(used)):
            full = [0] * d
            for k, n in zip(used, e, strict=True):
                full[k] = n
            weight = math.prod(math.comb(degree, n) * (-1) ** n for n in e)
            out = out + weight * F.col("_s" + "_".join(map(str, own)) + name[tuple(full)]) * _product([F.col(f"_a{k}") for k in used], [degree - n for n in e])
        return out

    low = F.greatest(over(whole), F.lit(0.0))
    if degree == 0:
        all_ = over(())
    elif degree % 2:
        all_ = over(()) * (-1) ** d
        for own in sorted(sets):
            all_ = all_ + 2 ** len(own) * (-1) ** (d - len(own)) * over(own)
    else:
        all_ = over(())
    value = F.coalesce(safe_ratio(low, all_), F.lit(0.0)) if degree else safe_ratio(low, all_)
    if kind != "CDF":
        apart = F.lit(0.0)
        for k in most:
            below = F.greatest(over((k,), (k,)), F.lit(0.0))
            above = F.greatest((over((), (k,)) - below) * (-1) ** degree, F.lit(0.0))
            apart = apart + safe_ratio(below, below + above)
        value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - apart + value))
        if kind == "cumulative hazard":
            value = -F.log(F.greatest(value, F.lit(FLOOR)))
    return rows.select(F.col("_k").alias(key), value.alias("value"))


def _product(factors: list[Column], powers) -> Column:
    out = F.lit(1.0)
    for f, n in zip(factors, powers, strict=True):
        for _ in range(n):
            out = out * f
    return out
