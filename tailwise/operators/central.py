"""Robust centres and rescaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailwise.functions.expr import col, finite, half_up, safe_ratio
from tailwise.operators.cumulative import cumulative
from tailwise.operators.moments import with_group_means
from tailwise.sources.staging import step


def gravity(df: DataFrame, column: str, groups: list[str] = (), discrete: bool = False, times: str | None = None) -> DataFrame:
    """Mean of the median, the modal bin's centre, the mean and the midhinge; bins by quartile width. times: a column that
    says how often a row stands there."""
    groups = list(groups)
    return gravity_of(step(cumulative(df.where(finite(column)), column, groups, {"n": F.col(times)} if times else None, 1).select(*groups, *SORTED), "sorted"), groups, discrete)


#: What gravity_of reads of each distinct value.
SORTED = ["v", "c", "n", "n_le", "n_all", "s1_all"]


def gravity_of(rows: DataFrame, groups: list[str], discrete: bool = False) -> DataFrame:
    """The gravity of groups from their distinct finite values (SORTED, by cumulative), which are read twice."""
    # Order statistics: the least value with enough values up to it.
    at = lambda k: F.min(F.when(F.col("n_le") >= k, F.col("v")))
    n = F.col("n_all")
    even = n % 2 == 0
    lo = lambda q: F.greatest(F.lit(1), F.floor(n * q))
    hi = lambda q: F.least(F.greatest(F.lit(1), F.ceil(n * q)), n)
    stats = rows.groupBy(*groups).agg(
        F.max("n_all").alias("n_all"), F.min("v").alias("low"), F.max("v").alias("high"), (F.max("c") + F.max("s1_all") / F.max("n_all")).alias("mean"),
        *[at(f(q)).alias(f"{name}{int(q * 100)}") for q in (0.25, 0.5, 0.75) for name, f in (("f", lo), ("c", hi))],
    )
    part = lambda q: F.when(even, F.col(f"f{int(q * 100)}")).otherwise(F.col(f"f{int(q * 100)}") + (n * q - F.floor(n * q)) * (F.col(f"c{int(q * 100)}") - F.col(f"f{int(q * 100)}")))
    stats = stats.select(*groups, "n_all", "low", "high", "mean", part(0.25).alias("q1"), F.when(even, F.col("f50")).otherwise((F.col("f50") + F.col("c50")) / 2).alias("q2"), part(0.75).alias("q3"), F.col("c50").alias("_second"))
    width = (F.col("q3") - F.col("q1")) / F.sqrt(n.cast("double"))
    stats = stats.withColumn("width", F.when(width > 0, width).otherwise((F.col("high") - F.col("low")) / 128))
    bins = F.least(F.greatest(F.floor(F.try_divide(F.col("high") - F.col("low"), F.col("width")) + 1e-12) + 1, F.lit(1)), 4 * n)
    stats = step(stats.withColumn("bins", F.coalesce(bins, F.lit(1)).cast("long")), "quartiles")
    keyed = stats.withColumnsRenamed({g: f"_g_{g}" for g in groups}).drop("n_all")
    binned = rows.join(keyed, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]) if groups else rows.join(F.broadcast(keyed))
    index = F.least(F.greatest(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("width"))), F.lit(0)), F.lit(0)), F.col("bins") - 1)
    counts = binned.withColumn("bin", index).groupBy(*groups, "bin").agg(F.sum("n").alias("c"), F.first("low").alias("low"), F.first("width").alias("width"))
    counts = step(counts, "bins")
    most = counts.groupBy(*groups).agg(F.max("c").alias("top"), F.max(F.struct("c", "bin"))["bin"].alias("_bin")).withColumnsRenamed({g: f"_g_{g}" for g in groups})
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    counts = counts.join(most, on) if groups else counts.join(F.broadcast(most))
    name = F.col("low") + F.col("bin") * F.col("width")
    near = F.abs(F.col("bin") - F.col("_bin")) <= 1
    modal = counts.groupBy(*groups).agg(
        F.sum(F.when(F.col("c") == F.col("top"), 1).otherwise(0)).alias("ties"), F.sum(name * F.col("c")).alias("all_w"), F.sum("c").alias("all_c"), F.sum(F.when(near, name * F.col("c"))).alias("near_w"), F.sum(F.when(near, F.col("c"))).alias("near_c"),
    )
    modal = modal.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.when(F.col("ties") == 1, F.col("near_w") / F.col("near_c")).otherwise(F.col("all_w") / F.col("all_c")).alias("mode"))
    both = stats.join(modal, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]) if groups else stats.join(F.broadcast(modal))
    value = 0.25 * (F.col("q2") + F.col("mode") + F.col("mean") + 0.5 * (F.col("q1") + F.col("q3")))
    small = F.when(n == 2, (F.col("low") + F.col("high")) / 2).otherwise(F.col("_second"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).when(n <= 3, small).otherwise(value)
    return both.select(*groups, (half_up(value).cast("double") if discrete else value).alias("gravity"))


def mode_discrete(df: DataFrame, column: str, groups: list[str] = ()) -> DataFrame:
    """Most frequent integer after rounding halves up; the mean of those that tie."""
    counts = df.where(finite(column)).groupBy(*groups, half_up(col(column)).alias("v")).agg(F.count("*").alias("c"))
    top = counts.withColumn("top", F.max("c").over(Window.partitionBy(*[F.col(g) for g in groups])))
    return top.where("c = top").groupBy(*groups).agg(F.avg("v").alias("mode"))


def rescale_minmax(df: DataFrame, column: str, a: float, b: float, groups: list[str] = ()) -> DataFrame:
    """df with rescaled: column mapped to a..b by its group's finite range; a constant becomes the middle."""
    x = col(column)
    bounds = df.where(finite(column)).groupBy(*groups).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).withColumnsRenamed({g: f"_g_{g}" for g in groups})
    out = df.join(bounds, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups], "left") if groups else df.join(F.broadcast(bounds))
    value = F.coalesce(a + (b - a) * safe_ratio(x - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit((a + b) / 2))
    return out.withColumn("rescaled", value).drop("_lo", "_hi", *[f"_g_{g}" for g in groups])


def rescale_riskneutral(df: DataFrame, column: str, a: float, b: float, maturity: float, kind: str = "Terminal", groups: list[str] = ()) -> DataFrame:
    """df with rescaled: column times target / mean; target a, or a * exp(b * maturity) for Terminal."""
    if a <= 0:
        raise ValueError("a must be positive")
    target = F.lit(float(a)) if kind == "Discounted" else a * F.exp(F.lit(float(b) * float(maturity)))
    return with_group_means(df, [column], list(groups)).withColumn("rescaled", col(column) * safe_ratio(target, F.col(f"mean_{column}"))).drop(f"mean_{column}")
