"""The piecewise regression of one column on another, smoothed or not, from aggregates: no group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailwise.functions.expr import col, finite
from tailwise.operators.cells import dependence, partition
from tailwise.operators.central import gravity
from tailwise.operators.cumulative import beside, same
from tailwise.operators.moments import copula
from tailwise.operators.smoothing import PIECE, score_pieces, smoothing_spline
from tailwise.sources.staging import step

#: From this dependence on, an end keeps its observed value.
FIRM = 0.95
#: An end of more rows than this is fitted by lines.
FEW = 5
#: A group of fewer rows takes half the depth.
SHORT = 100
#: What brings a double to the next greater one: more than half and at most one unit in its last place.
STEP = 2.0**-53 * (1 + 2.0**-51)


def strength(known: DataFrame, groups: list[str]) -> DataFrame:
    """groups, _dep: the mean of the dependence of y on x and the copula of x, x and y; 0.1 where it is no number."""
    own = dependence(known, "x", "y", groups, True).select(*groups, F.col("dependence").alias("_d"))
    own = beside(own, copula(known.select(*groups, "x", F.col("x").alias("_x"), "y"), ["x", "_x", "y"], groups), groups)
    value = (F.col("_d") + F.col("copula")) / 2
    return own.select(*groups, F.coalesce(F.nanvl(value, F.lit(0.1)), F.lit(0.1)).alias("_dep"))


def _merged(points: DataFrame, groups: list[str]) -> DataFrame:
    """groups, x, y: one point an x, at the gravity of its ys; written."""
    own = gravity(points.where(finite("x") & finite("y")), "y", [*groups, "x"])
    return step(own.select(*groups, "x", F.col("gravity").alias("y")), "points")


def _middle(points: DataFrame, known: DataFrame, groups: list[str]) -> DataFrame:
    """groups, x, y: the central point, at the gravity of the ys between the two middle points, or at the middle one."""
    whole = Window.partitionBy(*[F.col(g) for g in groups])  # a group's points are bounded by its depth
    placed = points.withColumns({"_k": F.row_number().over(whole.orderBy("x")) - 1, "_m": F.count("*").over(whole)})
    inner = placed.where((F.col("_k") == F.floor((F.col("_m") - 1) / 2)) | (F.col("_k") == F.floor(F.col("_m") / 2)))
    inner = step(inner.groupBy(*groups).agg(F.min("x").alias("_from"), F.max("x").alias("_to"), F.min_by("y", "x").alias("_y")), "middles")
    between = beside(known, inner.where("_from < _to"), groups).where(F.col("x").between(F.col("_from"), F.col("_to")))
    centre = beside(inner, gravity(between, "y", groups), groups).where("_from < _to")
    return inner.where("_from = _to").select(*groups, F.col("_from").alias("x"), F.col("_y").alias("y")).unionByName(centre.select(*groups, ((F.col("_from") + F.col("_to")) / 2).alias("x"), F.col("gravity").alias("y")))


def _by_lines(which: str, reach: str) -> Column:
    """Of an end: its name, place and observed y, whether it has rows enough for lines, and y there by two lines, through
    the rows beyond the outermost point and through the outer half of them, weighted by their rows."""
    x, y, end = F.col("x"), F.col("y"), F.col(f"_{which}")
    parts = []
    for stop in (F.col(reach), (end + F.col(reach)) / 2):
        own = x <= stop if which == "low" else x >= stop
        a, b = F.when(own, x), F.when(own, y)
        slope = F.coalesce(F.try_divide(F.covar_pop(a, b), F.var_pop(a)), F.lit(0.0))
        parts.append((F.count(a), F.avg(b) + slope * (F.first(end) - F.avg(a)), F.min(a) < F.max(a)))
    (outer, fit, _), (half, inner, wide) = parts
    return F.struct(F.lit(which).alias("_side"), F.first(end).alias("x"), F.first(f"_y{which}").alias("_seen"), (wide & (outer > FEW)).alias("_many"), ((outer * fit + half * inner) / (outer + half)).alias("_line"))


def _ends(points: DataFrame, known: DataFrame, facts: DataFrame, groups: list[str]) -> DataFrame:
    """groups, x, y: the regression's points at the least and the greatest x."""
    at = step(beside(facts, points.groupBy(*groups).agg(F.min("x").alias("_from"), F.max("x").alias("_to")), groups), "reaches")
    met, keys = beside(known, at, groups), [*groups, "_side"]
    ends = met.groupBy(*groups).agg(F.first("_dep").alias("_dep"), F.array(_by_lines("low", "_from"), _by_lines("high", "_to")).alias("_r"))
    ends = step(ends.select(*groups, "_dep", F.explode("_r").alias("_r")).select(*groups, "_dep", "_r.*"), "ends")
    sides = F.array(F.when(F.col("x") == F.col("_low"), F.lit("low")), F.when(F.col("x") == F.col("_high"), F.lit("high")))
    there = step(met.select(*groups, "y", F.explode(sides).alias("_side")).where("_side is not null"), "tips")
    values = there.distinct().groupBy(*keys).agg(F.avg("y").alias("_mean"))
    ends = beside(beside(ends, values, keys), gravity(there, "y", keys), keys)
    dep = F.col("_dep")
    value = F.when(dep >= 1, F.col("_seen")).when(F.col("_many") & (dep < FIRM), F.col("_line")).when(F.col("_many"), F.col("_mean")).otherwise(F.col("gravity"))
    return ends.select(*groups, "x", value.alias("y"))


def regression_points(df: DataFrame, x: str, y: str, groups: list[str] = (), order: int | None = None, centre: str = "off") -> tuple[DataFrame, DataFrame]:
    """(points, facts), both written. points: groups, x, y, what the regression passes through: the centres of the cells of
    x, split order times or by the dependence, a central point, and the ends. facts: groups, _dep, the dependence, and the
    ends of the data: _low, _high, _ylow, _yhigh (the least y where rows share the end). Rows without a finite x and y are
    left out. A group's points are at most 2 ** (depth - 1) + 3, whatever its rows; an empty table has none."""
    groups = list(groups)
    rows = df.select(*groups, col(x).alias("x"), col(y).alias("y"))
    known = step(rows.where(finite("x") & finite("y")), "known")
    ends = [F.min(F.struct(F.col("x"), F.col("y")))["y"].alias("_ylow"), F.min(F.struct((-F.col("x")).alias("x"), F.col("y")))["y"].alias("_yhigh")]
    facts = known.groupBy(*groups).agg(F.count("*").alias("_n"), F.min("x").alias("_low"), F.max("x").alias("_high"), *ends, F.min("y").alias("_least"), F.max("y").alias("_most")).where("_n > 0")
    facts = step(beside(facts, strength(known, groups), groups), "facts")
    depth = F.lit(max(1, math.floor(order + 0.5))) if order is not None else F.greatest(F.lit(1), F.floor(F.floor(F.col("_dep") * 10) / F.when(F.col("_n") < SHORT, 2).otherwise(1)))
    depths = facts.select(*groups, depth.cast("int").alias("_order"), (F.col("_dep") == 1).alias("_exact"))
    met = beside(known, depths.drop("_order"), groups)
    found = partition(met.where(~F.col("_exact")), "x", "y", groups, True, True, depths.drop("_exact"), 0, True, centre)
    if not depths.where("_exact").isEmpty():
        both = partition(met.where("_exact"), "x", "y", groups, True, order=1 if order is None else max(1, math.floor(order + 0.5)), least=0)
        found = found.unionByName(both)
    inside = lambda c, low, high: F.least(F.greatest(F.col(c), F.col(low)), F.col(high)).alias(c)
    points = _merged(beside(found, facts, groups).select(*groups, inside("x", "_low", "_high"), "y"), groups)
    middle = step(_middle(points, known, groups), "middle")
    points = _merged(points.unionByName(middle), groups)
    # The central point counts once more here.
    points = _merged(points.unionByName(_ends(points, known, facts, groups)).unionByName(middle), groups)
    return step(beside(points, facts, groups).select(*groups, "x", inside("y", "_least", "_most")), "points"), facts


def _outer(slopes: Column, last: bool) -> Column:
    """The mean of the two outermost distinct slopes."""
    found = F.array_distinct(slopes)
    two = F.slice(found, F.greatest(F.size(found) - 1, F.lit(1)) if last else F.lit(1), 2)
    return F.aggregate(two, F.lit(0.0), lambda a, b: a + b) / F.size(two)


def _with_slopes(points: DataFrame, facts: DataFrame, groups: list[str]) -> DataFrame:
    """facts with _p, a group's points in order, and _slopes between them."""
    own = points.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_p"))
    between = F.zip_with(F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.size("_p") - 1), lambda a, b: (b["y"] - a["y"]) / (b["x"] - a["x"]))
    slopes = F.transform(between, lambda s: F.when(s == float("inf"), 1.0).when(F.abs(s) < float("inf"), s).otherwise(0.0))
    return beside(own, facts, groups).withColumn("_slopes", F.when(F.size("_p") > 1, slopes).otherwise(F.array(F.lit(0.0))))


def _tails() -> tuple[Column, Column]:
    """Pieces ahead of the data and beyond them: lines from the observed ends."""
    after = F.col("_high") + (STEP * F.abs("_high") + 5e-324)
    piece = lambda start, x, y, slope: F.struct(start.alias("start"), F.col(x).alias("at_x"), F.col(y).alias("at_y"), slope.alias("slope"))
    return piece(F.lit(float("-inf")), "_low", "_ylow", _outer(F.col("_slopes"), False)), piece(after, "_high", "_yhigh", _outer(F.col("_slopes"), True))


def segments(points: DataFrame, facts: DataFrame, groups: list[str] = ()) -> DataFrame:
    """groups, start, at_x, at_y, slope: the lines between regression_points, and beyond the data lines that go on from the
    observed ends along the mean of the two outermost distinct slopes."""
    first, last = _tails()
    lines = F.transform("_p", lambda p, k: F.struct(p["x"].alias("start"), p["x"].alias("at_x"), p["y"].alias("at_y"), F.element_at("_slopes", F.least(k + 1, F.size("_slopes"))).alias("slope")))
    return _with_slopes(points, facts, list(groups)).select(*groups, F.explode(F.concat(F.array(first), lines, F.array(last))).alias("_r")).select(*groups, "_r.*")


def fit_regression(df: DataFrame, x: str, y: str, groups: list[str] = (), order: int | None = None, centre: str = "off") -> DataFrame:
    """groups, start, at_x, at_y, slope: the segments of each group's piecewise regression (see regression_points)."""
    return step(segments(*regression_points(df, x, y, groups, order, centre), groups), "segments")


def fit_smooth(df: DataFrame, x: str, y: str, groups: list[str] = (), order: int | None = None) -> DataFrame:
    """groups and the PIECEs of each group's regression with its points smoothed by a cubic spline, whose parameter is the
    mean of the dependence and 1/2. Beyond the data lines go on from the observed ends along the slopes between the
    smoothed points. Groups whose points have no spline (fewer than four, or no
    interquartile range) keep their segments."""
    groups = list(groups)
    points, facts = regression_points(df, x, y, groups, order)
    spars = facts.select(*groups, ((F.col("_dep") + 0.5) / 2).alias("_spar"))
    spline = step(smoothing_spline(points, "x", "y", groups, spars), "spline")
    # A spline's first piece reaches back for ever: here it starts with the data.
    inner = spline.withColumn("start", F.col("at_x"))
    smooth = score_pieces(points, "x", spline, groups).where("estimate is not null").select(*groups, "x", F.col("estimate").alias("y"))
    tails = _with_slopes(smooth, facts, groups).select(*groups, F.explode(F.array(*_tails())).alias("_r")).select(*groups, "_r.*")
    keyed = spline.select(*[F.col(g).alias(f"_k_{g}") for g in groups], F.lit(True).alias("_one")).distinct()
    rest = segments(points, facts, groups).join(keyed, same(groups, [f"_k_{g}" for g in groups]), "left_anti")
    lines = tails.unionByName(rest).select(*groups, "start", "at_x", F.col("at_y").alias("a"), F.col("slope").alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))
    return step(inner.unionByName(lines).select(*groups, *PIECE), "pieces")
