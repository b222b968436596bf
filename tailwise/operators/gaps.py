"""Gaps of series filled by the piecewise regression of greatest order on their places: no series in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailwise.functions.expr import col, half_up
from tailwise.operators.causation import ranked
from tailwise.operators.central import gravity
from tailwise.operators.cumulative import beside
from tailwise.operators.regression import strength
from tailwise.sources.staging import step

#: From this dependence on, an end keeps its observed value.
FIRM = 0.95
#: An end of more rows than this is fitted by lines.
FEW = 5


def _end(which: str) -> Column:
    """The regression's y at an end: two lines there, through its side's rows and through the outer half of them, by
    their rows; the observed y where the dependence is firm or the rows are few."""
    x, y = F.col("x"), F.col("y")
    end, centre = F.col(f"_{which}"), F.col("_cx")
    side = lambda reach: x <= reach if which == "low" else x >= reach
    parts = []
    for own in (side(centre), side((end + centre) / 2)):
        a, b = F.when(own, x), F.when(own, y)
        slope = F.coalesce(F.try_divide(F.covar_pop(a, b), F.var_pop(a)), F.lit(0.0))
        parts.append((F.count(a), F.avg(b) + slope * (F.first(end) - F.avg(a))))
    (outer, fit), (half, inner) = parts
    fitted = (half > 1) & (outer > FEW) & (F.first("_dep") < FIRM)
    return F.when(fitted, (outer * fit + half * inner) / (outer + half)).otherwise(F.first(f"_y{which}"))


def three_points(known: DataFrame, groups: list[str]) -> DataFrame:
    """groups, and the regression of greatest order of y on whole numbers x that differ within a group: _low, _cx, _high, the
    xs of its points; _elow, _cy, _ehigh their ys; _ylow, _yhigh the observed ys at the ends. known is read several times."""
    facts = known.groupBy(*groups).agg(F.min("x").alias("_low"), F.max("x").alias("_high"), F.min_by("y", "x").alias("_ylow"), F.max_by("y", "x").alias("_yhigh"), F.min("y").alias("_least"), F.max("y").alias("_most"))
    at = beside(facts, gravity(known, "x", groups).select(*groups, half_up(F.col("gravity")).cast("double").alias("_cx")), groups)
    at = beside(at, gravity(known, "y", groups).withColumnRenamed("gravity", "_cy"), groups)
    at = step(beside(at, strength(known, groups), groups), "centres")
    ends = beside(known, at, groups).groupBy(*groups).agg(_end("low").alias("_elow"), _end("high").alias("_ehigh"))
    at = beside(at, step(ends, "ends"), groups)
    inside = lambda c: F.least(F.greatest(c, F.col("_least")), F.col("_most"))
    # An end that the central point falls on takes its y.
    own = lambda e: inside(F.when(F.col("_cx") == F.col(f"_{e}"), F.col("_cy")).otherwise(F.col(f"_e{e}"))).alias(f"_e{e}")
    return at.select(*groups, "_low", "_cx", "_high", own("low"), inside(F.col("_cy")).alias("_cy"), own("high"), "_ylow", "_yhigh")


def fill_gaps(df: DataFrame, columns: list[str], order: str, groups: list[str] = ()) -> DataFrame:
    """groups, order, column, value, kind: a row for each row and column, the series of all columns and groups side by side.
    kind is known; inside or before, a gap after the first known value or ahead of it, filled from the regression on
    places 1, 2, ... in the order of order, before the first value along the mean of its distinct slopes; trailing, a gap
    after the last known value, whose value stays NULL, as in a series without any (unknown). NaN is a gap. Rows equal in
    order follow each other by their values. An empty table gives no row."""
    groups = list(groups)
    keys = [*groups, "column"]
    rows = df.select(*groups, F.col(order).alias("_o"), *[col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_v{k}").alias("y")) for k, c in enumerate(columns)])
    long = ranked(rows, groups, ["_o"], "_place").select(*groups, "_o", (F.col("_place") + 1).cast("double").alias("x"), F.explode(each).alias("_r"))
    long = step(long.select(*keys[:-1], "_o", "x", "_r.column", F.when(~F.isnan("_r.y"), F.col("_r.y")).alias("y")), "series")
    model = step(three_points(step(long.where("y is not null").select(*keys, "x", "y"), "known"), keys), "model")
    met = long.join(model.withColumnsRenamed({k: f"_k_{k}" for k in keys}), _same(keys), "left")
    x, low, centre = F.col("x"), F.col("_low"), F.col("_cx")
    first = F.try_divide(F.col("_cy") - F.col("_elow"), centre - low)
    second = F.try_divide(F.col("_ehigh") - F.col("_cy"), F.col("_high") - centre)
    mean = F.when(first == second, first).otherwise(F.coalesce((first + second) / 2, first, second, F.lit(0.0)))
    kind = F.when(F.col("y").isNotNull(), "known").when(low.isNull(), "unknown").when(x < low, "before").when(x > F.col("_high"), "trailing").otherwise("inside")
    fit = F.when(x < low, F.col("_ylow") + (x - low) * mean).when(x > F.col("_high"), None).when(x < centre, F.col("_elow") + (x - low) * first).otherwise(F.col("_cy") + F.coalesce((x - centre) * second, F.lit(0.0)))
    return met.select(*groups, F.col("_o").alias(order), "column", F.coalesce("y", fit).alias("value"), kind.alias("kind"))


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return out
