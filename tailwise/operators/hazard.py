"""The hazard of a column: the slope of its CDF, smoothed by a regression, over its survival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailwise.functions.expr import col, finite
from tailwise.operators.causation import ranked
from tailwise.operators.cumulative import beside, same
from tailwise.operators.quantile import FLOOR, cdf
from tailwise.operators.regression import fit_regression
from tailwise.operators.smoothing import score_pieces
from tailwise.sources.staging import step

#: Sorted rows that a slope of the CDF spans at most.
SPAN = 10
#: The hazard is at most this.
MOST = 1e6


def hazard(df: DataFrame, column: str, degree: int = 0, groups: list[str] = ()) -> DataFrame:
    """groups, v, h: at each distinct value the slope of the CDF of an integer degree, fitted by the piecewise regression,
    over the survival (at least FLOOR), within 0 and MOST. A row's slope runs from the row SPAN / 2 places before to the one
    as far behind it in the order of values, as far as there are rows; rows meet these by their places, so no group is one
    task's work. A slope is at least FLOOR; where both rows have one value there is none, and the fit goes without it. NULL
    where the group has no slope at all (fewer than three rows, or ties everywhere). NULL, NaN and infinite values are left
    out; an empty table gives no row."""
    groups = list(groups)
    rows = step(df.where(finite(column)).select(*groups, col(column).alias("v")), "finite")
    curve = step(cdf(rows, "v", degree, groups), "curve")
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("_n"))
    placed = step(beside(ranked(rows, groups, ["v"], "_i"), sizes, groups), "placed")
    half = F.floor(F.least(F.lit(SPAN), F.col("_n") - 1) / 2)
    keys = [*groups, "_i"]
    asked = placed.select(*groups, F.col("v").alias("x"), F.greatest(F.lit(0), F.col("_i") - half).alias("_from"), F.least(F.col("_n") - 1, F.col("_i") + half).alias("_to"))
    known = step(placed.join(curve.withColumnsRenamed({c: f"_k_{c}" for c in (*groups, "v")}), same([*groups, "v"], [f"_k_{c}" for c in (*groups, "v")])).select(*keys, "v", "CDF"), "known")
    for which in ("from", "to"):
        own = known.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("v").alias(f"_v{which}"), F.col("CDF").alias(f"_p{which}"))
        asked = asked.join(own, same([*groups, f"_{which}"], [f"_g_{k}" for k in keys])).drop(*[f"_g_{k}" for k in keys])
    slope = F.greatest((F.col("_pto") - F.col("_pfrom")) / (F.col("_vto") - F.col("_vfrom")), F.lit(FLOOR))
    slopes = asked.where("_vto > _vfrom").select(*groups, "x", slope.alias("y"))
    fit = fit_regression(slopes, "x", "y", groups)
    lines = fit.select(*groups, "start", "at_x", F.col("at_y").alias("a"), F.col("slope").alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))
    h = F.least(F.greatest(F.col("estimate") / F.greatest(1 - F.col("CDF"), F.lit(FLOOR)), F.lit(0.0)), F.lit(MOST))
    return score_pieces(curve, "v", lines, groups).select(*groups, "v", F.when(F.col("estimate").isNotNull(), h).alias("h"))
