"""Running counts and centred power sums over sorted values of groups, in parallel within a group too."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailwise.functions.expr import col
from tailwise.sources.staging import step

#: A group with more distinct values than this is cut into value ranges, whatever the number of groups.
SPLIT = 100_000
#: Value ranges of a large group, found in three steps of FANOUT.
FANOUT = 10
RANGES = FANOUT**3


def same(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of two lists of columns."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with other's columns of the same keys; other has a row a key. Which side is sent is left to the optimizer, which
    knows the sizes by then; a table of one row is sent."""
    if not keys:
        return df.join(F.broadcast(other))
    other = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return df.join(other, same(keys, [f"_k_{k}" for k in keys])).drop(*[f"_k_{k}" for k in keys])


def powers_of(x: Column, most: int) -> list[Column]:
    """x ** 1 .. x ** most."""
    out = [x]
    while len(out) < most:
        out.append(out[-1] * x)
    return out[:most]


def _range_of(v: Column) -> Column:
    """The number of cuts below v: among every FANOUT ** 2-th first, then among the ones between two of those, ..."""
    below = F.size(F.filter("_cuts_2", lambda c: c < v))
    for k in (1, 0):
        below = below * FANOUT + F.size(F.filter(F.slice(f"_cuts_{k}", below * FANOUT + 1, FANOUT - 1), lambda c: c < v))
    return F.when(F.col("_cuts_0").isNull(), F.lit(0)).otherwise(below)


def cumulative(df: DataFrame, value: str, groups: list[str] = (), measures: dict[str, Column] | None = None, powers: int = 0, centred: bool | str = True) -> DataFrame:
    """groups, v (distinct values), v_after (the next one), c (the group's centre), and for each measure <name> its sum at
    v, <name>_le up to v and <name>_all. Measures are n (rows, unless given), those given, d (1 for each distinct value),
    and with powers s1, s2, ...: sums of (v - c) ** k, weighted by n, so that no digits are lost far from 0.
    The centre is the mean of the finite distinct values, with centred="least" the least of them, without centred 0.

    Ties are one row, so frames are inclusive. Groups with many values are cut into ranges at approximate quantiles;
    ranges are summed first and their totals carried, so no group's sort is one task's work. NULL and NaN are left out."""
    groups, measures = list(groups), {"n": F.lit(1).cast("long")} | (measures or {})
    x = col(value)
    base = df.select(*groups, x.alias("v"), *[m.alias(k) for k, m in measures.items()]).where(F.col("v").isNotNull() & ~F.isnan("v"))
    base = base.groupBy(*groups, "v").agg(*[F.sum(k).alias(k) for k in measures])
    inner = F.when((F.col("n") > 0) & (F.abs("v") < float("inf")), F.col("v"))
    stats = base.groupBy(*groups).agg(
        (F.coalesce((F.min if centred == "least" else F.avg)(inner), F.lit(0.0)) if centred else F.lit(0.0)).alias("c"),
        F.when(F.count("*") > SPLIT, F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 10_000)).alias("_cuts_0"),
    )
    # Every FANOUT-th and FANOUT ** 2-th; a slice between two of the coarser ones has FANOUT - 1 of the finer.
    every = lambda step: F.transform(F.sequence(F.lit(step), F.lit(RANGES - step), F.lit(step)), lambda k: F.element_at("_cuts_0", k))
    stats = stats.withColumns({"_cuts_1": every(FANOUT), "_cuts_2": every(FANOUT**2)})
    # Written, so that the join knows its size: rows meet a small table where they are, instead of by their group.
    base = beside(base, step(stats, "ranges") if groups else stats, groups).withColumn("_part", _range_of(F.col("v"))).drop("_cuts_0", "_cuts_1", "_cuts_2")
    names = [*measures, "d", *[f"s{k}" for k in range(1, powers + 1)]]
    own = {f"s{k + 1}": F.col("n") * p for k, p in enumerate(powers_of(F.col("v") - F.col("c"), powers))}
    # Dealt once by one key, in which nulls are equal: the ranges' totals, the running sums and their join share it, so the
    # rows are shuffled once; both read all its columns.
    base = base.withColumns({"d": F.lit(1).cast("long")} | own)
    base = base.select("*", F.struct(*[F.col(g) for g in groups], F.col("_part")).alias("_key")).drop("_part").repartition("_key")
    totals = base.groupBy("_key").agg(F.min("v").alias("_first"), F.max("c").alias("_c"), *[F.sum(k).alias(f"_s_{k}") for k in names])
    whole = Window.partitionBy(*[F.col(f"_key.`{g}`") for g in groups])
    ordered = whole.orderBy("_key._part")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_key").alias("_tkey"), "_c", F.lead("_first").over(ordered).alias("_first"), *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in names], *[F.sum(f"_s_{k}").over(whole).alias(f"{k}_all") for k in names])
    inside = Window.partitionBy("_key").orderBy("v")
    run = base.select("*", F.lead("v").over(inside).alias("_after"), *[F.sum(k).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{k}_le") for k in names])
    run = run.join(totals, F.col("_key") == F.col("_tkey"))
    return run.select(*groups, "v", F.coalesce("_after", "_first").alias("v_after"), F.coalesce("c", "_c").alias("c"), *names, *[(F.col(f"{k}_le") + F.col(f"_b_{k}")).alias(f"{k}_le") for k in names], *[f"{k}_all" for k in names])


def side_sum(degree: int, at: Column, sums: list[Column], le: bool = True) -> Column:
    """Sum of (at - x) ** degree (or (x - at) ** degree) from x's power sums of 0 .. degree; not below 0, which only
    rounding gives."""
    out, u = F.lit(0.0), [F.lit(1.0), *powers_of(at, degree)]
    for k in range(degree + 1):
        sign = (-1) ** (k if le else degree - k)
        out = out + sign * comb(degree, k) * sums[k] * u[degree - k]
    return F.when(out < 0, 0.0).otherwise(out) if degree else out


def lpm_at(degree: int, le: bool = True) -> Column:
    """Lower (or upper) partial moment of an integer degree at v from cumulative's power sums; NULL without rows."""
    names = ["n", *[f"s{k}" for k in range(1, degree + 1)]]
    sums = [F.col(f"{k}_le") if le else F.col(f"{k}_all") - F.col(f"{k}_le") for k in names]
    return F.try_divide(side_sum(degree, F.col("v") - F.col("c"), sums, le), F.col("n_all").cast("double"))
