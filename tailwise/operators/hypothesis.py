"""Nonlinear ANOVA between groups: certainty that they share a location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailwise.functions.expr import col, finite, lpm_ratio, upm_ratio
from tailwise.operators.quantile import lpm_vars

#: Targets by name: the share that lies beyond them, and whether they are lower ones.
TAILS = {"u25": (0.25, False), "l25": (0.25, True), "u125": (0.125, False), "l125": (0.125, True)}
#: Their weights beside the location's.
WEIGHTS = {"u25": 0.5, "l25": 0.5, "u125": 0.25, "l125": 0.25}


def _located(df: DataFrame, group: str, value: str, medians: bool) -> DataFrame:
    """g, n, m (mean or median), and the four tail targets of each group."""
    centre = F.percentile(F.col("x"), F.lit(0.5)) if medians else F.avg("x")
    rows = df.select(F.col(group).alias("g"), col(value).alias("x"))
    tails = lpm_vars(rows, "x", {k: p if low else 1 - p for k, (p, low) in TAILS.items()}, 1, ["g"])
    return rows.groupBy("g").agg(F.count("*").cast("double").alias("n"), centre.alias("m")).join(tails, "g")


def _ratios(rows: DataFrame, keys: list[str], medians: bool) -> DataFrame:
    """The shares of each group around the targets beside its rows."""
    own = [(lpm_ratio if low else upm_ratio)("x", F.col(f"t_{k}"), 1).alias(k) for k, (_, low) in TAILS.items()]
    return rows.groupBy(*keys).agg(lpm_ratio("x", F.col("t_m"), 0 if medians else 1).alias("cdf"), *own)


def _certainty(n: Column, means_only: bool) -> Column:
    """From the shares of two groups, a_<name> and b_<name>."""
    worst = lambda c, p: F.least(F.lit(p), F.greatest(F.abs(F.col(f"a_{c}") - p), F.abs(F.col(f"b_{c}") - p)))
    share = lambda c, p: F.pow((p - worst(c, p)) / p, 2)
    rho = share("cdf", 0.5)
    if not means_only:
        for k, (p, _) in TAILS.items():
            rho = rho + WEIGHTS[k] * share(k, p)
        rho = rho / 2.5
    return F.least(F.lit(1.0), rho * F.pow((n - 2) / n, 2))


def anova(df: DataFrame, group: str, value: str, pairwise: bool = True, means_only: bool = False, medians: bool = False) -> DataFrame:
    """Certainty of each pair of groups a < b that they share a location: a, b, control and treatment statistics, their
    grand one, their CDFs at it, certainty. Pairwise targets are the pair's own; else all groups' (what a mean over the
    pairs makes the certainty of the whole). Groups are few: their pairs are sent to all tasks. Non-finite values go."""
    df = df.where(finite(value) & F.col(group).isNotNull())
    each = _located(df, group, value, medians)
    side = lambda s: each.select(*[F.col(c).alias(f"{s}_{c}") for c in each.columns])
    pairs = side("a").join(F.broadcast(side("b")), F.col("a_g") < F.col("b_g"))
    if pairwise:
        grand = (F.col("a_n") * F.col("a_m") + F.col("b_n") * F.col("b_m")) / (F.col("a_n") + F.col("b_n"))
        pairs = pairs.withColumns({"t_m": grand} | {f"t_{k}": (F.col(f"a_{k}") + F.col(f"b_{k}")) / 2 for k in TAILS})
    else:
        pairs = pairs.join(F.broadcast(each.agg(F.avg("m").alias("t_m"), *[F.avg(k).alias(f"t_{k}") for k in TAILS])))
    pairs = pairs.select("a_g", "b_g", F.col("a_n") + F.col("b_n"), "a_m", "b_m", "t_m", *[f"t_{k}" for k in TAILS]).toDF("a", "b", "n", "control", "treatment", "t_m", *[f"t_{k}" for k in TAILS])
    targets = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("g"), "t_m", *[f"t_{k}" for k in TAILS])
    rows = df.select(F.col(group).alias("_g"), col(value).alias("x")).join(F.broadcast(targets), F.col("_g") == F.col("g"))
    found = _ratios(rows, ["a", "b", "g"], medians)
    of = lambda s: found.where(F.col("g") == F.col(s)).select(F.col("a").alias(f"_{s}a"), F.col("b").alias(f"_{s}b"), *[F.col(c).alias(f"{s}_{c}") for c in ("cdf", *TAILS)])
    out = pairs
    for s in "ab":
        out = out.join(of(s), (F.col("a") == F.col(f"_{s}a")) & (F.col("b") == F.col(f"_{s}b")))
    return out.select("a", "b", "control", "treatment", F.col("t_m").alias("grand"), F.col("a_cdf").alias("control_cdf"), F.col("b_cdf").alias("treatment_cdf"), _certainty(F.col("n"), means_only).alias("certainty"))


def anova_all(df: DataFrame, group: str, value: str, means_only: bool = False, medians: bool = False) -> DataFrame:
    """One row: certainty that all groups share a location."""
    return anova(df, group, value, False, means_only, medians).agg(F.avg("certainty").alias("certainty"))


def anova_pair(df: DataFrame, group: str, value: str, control: str, treatment: str, means_only: bool = False, medians: bool = False) -> DataFrame:
    """One row: control, treatment and grand means, their CDFs at the grand mean, certainty."""
    found = anova(df.where(F.col(group).isin([control, treatment])), group, value, True, means_only, medians)
    turned = F.col("a") != F.lit(control)
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return found.select(pick("control", "treatment").alias("control"), pick("treatment", "control").alias("treatment"), "grand", pick("control_cdf", "treatment_cdf").alias("control_cdf"), pick("treatment_cdf", "control_cdf").alias("treatment_cdf"), "certainty")
