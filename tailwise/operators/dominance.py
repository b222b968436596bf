"""Stochastic superiority and dominance between the groups of a column: names, and pairs of names, are rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailwise.functions.expr import col
from tailwise.operators.cumulative import beside, cumulative, side_sum
from tailwise.sources.staging import step

#: Distinct values of a name in a block of the common grid, on average.
BLOCK = 16
STATE = ["n", "s1", "s2"]


def _rows(df: DataFrame, group: str, value: str, names: list[str] | None, by: list[str]) -> DataFrame:
    """by, name, x, _m: values and their common mean."""
    if names is not None:
        df = df.where(F.col(group).isin(names))
    rows = df.select(*by, F.col(group).alias("name"), col(value).alias("x")).where(F.col("name").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))
    middle = rows.agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("_m"))
    return rows.join(F.broadcast(middle))


def chunks(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, block, name, n_all, least, mean, c, edge, before, own: the curve of each name in each block of the grid of all
    names' values. Sums are around c, the name's least value: each is then as large as the curve's terms, so a curve is 0
    where it begins and the sums of whole numbers are exact. mean is around the common mean, rounded to a whole number. own has the name's distinct values there (v, n_at, and n, s1, s2 up to v), before the sums up to the
    block, edge is the block's first value. Blocks hold BLOCK values a name on average; equal values share one."""
    sums = cumulative(rows, "x", [*by, "name"], {"t": F.col("x") - F.rint("_m")}, 2, "least")
    own = F.struct("v", F.col("n").alias("n_at"), *[F.col(f"{k}_le").alias(k) for k in STATE])
    flat = step(sums.select(*by, "name", "v", "n_all", (F.col("t_all") / F.col("n_all")).alias("mean"), "c", own.alias("own")), "curves")
    place = cumulative(flat.select(*by, "v"), "v", by)
    many = flat.groupBy(*by).agg(F.count_distinct("name").alias("_many"))
    place = beside(place.select(*by, "v", (F.col("n_le") - F.col("n")).alias("_rank")), many, by)
    place = place.select(*by, "v", F.floor(F.col("_rank") / (BLOCK * F.col("_many"))).alias("block"))
    placed = beside(flat, place, [*by, "v"])
    held = placed.groupBy(*by, "block", "name").agg(F.sort_array(F.collect_list("own")).alias("own"))
    each = placed.groupBy(*by, "name").agg(F.max("n_all").alias("n_all"), F.max("mean").alias("mean"), F.max("c").alias("c"), F.min("v").alias("least"))
    edges = place.groupBy(*by, "block").agg(F.min("v").alias("edge"))
    keys = [*by, "block", "name"]
    every = each.join(edges, by) if by else each.join(F.broadcast(edges))  # names x blocks, of which there are rows / (BLOCK * names)
    every = every.join(held.withColumnsRenamed({k: f"_k_{k}" for k in keys}), _equal(keys), "left").drop(*[f"_k_{k}" for k in keys])
    earlier = Window.partitionBy(*[F.col(k) for k in [*by, "name"]]).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.element_at("own", -1), True).over(earlier)
    nothing = F.struct(F.lit(None).cast("double").alias("v"), *[F.lit(0).cast("long").alias(k) for k in ("n_at", "n")], *[F.lit(0.0).alias(k) for k in ("s1", "s2")])
    before = F.coalesce(last, nothing)
    none = F.filter(F.array(F.element_at("own", -1)), lambda _: F.lit(False))
    return step(every.select(*keys, "n_all", "mean", "least", "c", "edge", before.alias("before"), F.coalesce("own", none).alias("own")), "chunks")


def _equal(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return out


def _sides(parts: DataFrame, by: list[str]) -> DataFrame:
    """Each unordered pair of names in each block, side by side as a and b."""
    side = lambda s: parts.select(*[F.col(k).alias(f"_{s}_{k}") for k in [*by, "block"]], F.col("name").alias(s), F.struct("n_all", "mean", "least", "c", "edge", "before", "own").alias(f"_{s}"))
    on = F.col("_a_block") == F.col("_b_block")
    for k in by:
        on = on & (F.col(f"_a_{k}") == F.col(f"_b_{k}"))
    return side("a").join(side("b"), on & (F.col("a") < F.col("b"))).select(*[F.col(f"_a_{k}").alias(k) for k in by], "a", "b", "_a", "_b")


def _at(curve: str, v: Column, use) -> Column:
    """use applied to the sums of a chunk up to v. A one-element array binds them to a name: they are looked up once."""
    found = F.coalesce(F.try_element_at(F.filter(F.col(f"{curve}.own"), lambda e: e["v"] <= v), F.lit(-1)), F.col(f"{curve}.before"))
    return F.get(F.transform(F.array(found), use), F.lit(0))


def _height(state: Column, v: Column, n_all: Column, degree: int) -> Column:
    """The curve of the degree (LPM of degree - 1) at v, from the name's c on, by the sums of the values up to it."""
    return side_sum(degree - 1, v, [state[k] for k in STATE]) / n_all


def superiority(df: DataFrame, group: str, value: str, names: list[str] | None = None) -> DataFrame:
    """x, y, p_gt = P(X > Y), p_tie, p_star = p_gt + p_tie / 2 for each ordered pair."""
    pairs = _sides(chunks(_rows(df, group, value, names, []), []), [])

    def met(e: Column) -> Column:
        n = _at("_b", e["v"], lambda s: s["n"])
        tie = F.coalesce(F.get(F.filter(F.col("_b.own"), lambda f: f["v"] == e["v"]), F.lit(0))["n_at"], F.lit(0))
        weight = e["n_at"].cast("double")
        return F.struct((weight * (n - tie)).alias("more"), (weight * tie).alias("tie"))

    add = lambda field: F.aggregate(F.col("_p"), F.lit(0.0), lambda t, m: t + m[field])
    size = (F.col("_a.n_all").cast("double") * F.col("_b.n_all")).alias("size")
    counted = pairs.select("a", "b", size, F.transform("_a.own", met).alias("_p")).select("a", "b", "size", add("more").alias("more"), add("tie").alias("tie"))
    each = counted.groupBy("a", "b").agg((F.sum("more") / F.max("size")).alias("more"), (F.sum("tie") / F.max("size")).alias("tie"))
    ways = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.col("more").alias("p_gt"), F.col("tie").alias("p_tie")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), (1 - F.col("more") - F.col("tie")).alias("p_gt"), F.col("tie").alias("p_tie")))
    return each.select(F.explode(ways).alias("c")).select("c.*", (F.col("c.p_gt") + 0.5 * F.col("c.p_tie")).alias("p_star"))


def dominance(df: DataFrame, group: str, value: str, names: list[str] | None = None, degree: int = 1, tolerance: float = 0.0, by: list[str] = ()) -> DataFrame:
    """by, x, y, dominates: x stands at or below y at every value of the two on the curve of the degree (1: ECDF, 2 and 3:
    LPM of degree 1 and 2), with no lower minimum and, from degree 2, no lower mean. Samples may differ in size; by gives
    each value of those columns pairs of its own. tolerance is what sums of doubles in another order may differ by,
    relative to the curve.

    Pairs are rows: the plan has the same size for any number of names. Up to degree 2 a curve is linear between values,
    so pairs that cross at the blocks' edges, neither of which can dominate, go before any value is compared."""
    by = list(by)
    parts = chunks(_rows(df, group, value, names, by), by)
    pairs = _sides(parts, by)
    over = lambda a, b: a - b > tolerance * F.abs(b)
    if degree < 3:
        edge = lambda s: _height(F.col(f"_{s}.before"), F.col("_a.edge") - F.col(f"_{s}.c"), F.col(f"_{s}.n_all"), degree)
        crossed = pairs.select(*by, "a", "b", over(edge("a"), edge("b")).alias("_i"), over(edge("b"), edge("a")).alias("_j")).groupBy(*by, "a", "b").agg(F.bool_or("_i").alias("_i"), F.bool_or("_j").alias("_j"))
        pairs = beside(pairs, crossed.where(~(F.col("_i") & F.col("_j"))).drop("_i", "_j"), [*by, "a", "b"])

    def one(s: str, v: Column) -> Column:
        return _at(f"_{s}", v, lambda state: _height(state, v - F.col(f"_{s}.c"), F.col(f"_{s}.n_all"), degree))

    def both(e: Column) -> Column:
        return F.struct(*[one(s, e["v"]).alias(s) for s in "ab"])

    met = pairs.select(*by, "a", "b", "_a.mean", "_a.least", F.col("_b.mean").alias("mean_b"), F.col("_b.least").alias("least_b"), F.transform(F.concat("_a.own", "_b.own"), both).alias("_p"))
    some = lambda test: F.exists("_p", test)
    met = met.select(
        *by, "a", "b", "mean", "least", "mean_b", "least_b",
        some(lambda p: over(p["a"], p["b"])).alias("_i"), some(lambda p: over(p["b"], p["a"])).alias("_j"),
        some(lambda p: F.abs(p["a"] - p["b"]) > tolerance * F.abs(p["b"])).alias("_di"), some(lambda p: F.abs(p["a"] - p["b"]) > tolerance * F.abs(p["a"])).alias("_dj"),
    )
    met = met.groupBy(*by, "a", "b").agg(*[F.bool_or(c).alias(c) for c in ("_i", "_j", "_di", "_dj")], *[F.max(c).alias(c) for c in ("mean", "least", "mean_b", "least_b")])
    fits = lambda s, t: (F.col(f"least{s}") >= F.col(f"least{t}")) & ((F.col(f"mean{s}") >= F.col(f"mean{t}")) if degree > 1 else F.lit(True))
    met = met.select(*by, "a", "b", (F.col("_di") & ~F.col("_i") & fits("", "_b")).alias("_i"), (F.col("_dj") & ~F.col("_j") & fits("_b", "")).alias("_j"))
    found = met.select(*by, F.explode(F.array(*[F.struct(F.col(s).alias("x"), F.col(t).alias("y"), F.col(f).alias("dominates")) for s, t, f in (("a", "b", "_i"), ("b", "a", "_j"))])).alias("c")).select(*by, "c.*")
    if degree > 2:
        return found
    lost = crossed.where(F.col("_i") & F.col("_j")).select(*by, F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("c")).select(*by, "c.*", F.lit(False).alias("dominates"))
    return found.unionByName(lost)


def _moments(df: DataFrame, group: str, value: str, names: list[str]) -> dict[str, dict]:
    """n, greatest value and power sums of each name around the common centre: a row a name, in one job."""
    x = F.col("x")
    rows = _rows(df, group, value, names, []).withColumn("x", x - F.col("_m"))
    found = rows.groupBy("name").agg(F.count("*").alias("n"), F.max("x").alias("top"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.sum(x * x * x).alias("s3")).collect()
    return {r["name"]: r.asDict() for r in found}


def _order(left: list[str], at: dict[str, dict], degree: int) -> list[str]:
    """Names in the order of their LPM at the greatest value of those left, ties by place."""
    t = max((at[n]["top"] for n in left), default=0.0)

    def height(m: dict) -> float:
        return {1: t * m["n"] - m["s1"], 2: t * t * m["n"] - 2 * t * m["s1"] + m["s2"], 3: t**3 * m["n"] - 3 * t * t * m["s1"] + 3 * t * m["s2"] - m["s3"]}[degree] / m["n"]

    return sorted(left, key=lambda n: (height(at[n]), left.index(n)))


def peel(order: list[str], edges: set[tuple[str, str]]) -> list[str]:
    """Those of order that nothing kept before dominates."""
    kept: list[str] = []
    for name in order:
        if not any((k, name) in edges for k in kept):
            kept.append(name)
    return kept


def _edges(df: DataFrame, group: str, value: str, names: list[str], degree: int, tolerance: float) -> set[tuple[str, str]]:
    return {(r["x"], r["y"]) for r in dominance(df, group, value, names, degree, tolerance).where("dominates").collect()}  # pairs of names


def efficient_set(df: DataFrame, group: str, value: str, names: list[str], degree: int, tolerance: float = 0.0) -> list[str]:
    """Names that no other dominates, in the order of their LPM at the greatest value."""
    at = _moments(df, group, value, names)
    return peel(_order([n for n in names if n in at], at, degree), _edges(df, group, value, names, degree, tolerance))


def clusters(df: DataFrame, group: str, value: str, names: list[str], degree: int, min_cluster: int = 1, tolerance: float = 0.0) -> list[list[str]]:
    """Efficient sets taken off one after another; a last part below min_cluster joins the one before. Two jobs, whatever
    the number of sets."""
    at, edges = _moments(df, group, value, names), _edges(df, group, value, names, degree, tolerance)
    left, out = [n for n in names if n in at], []
    while left:
        own = peel(_order(left, at, degree), edges)
        left = [n for n in left if n not in own]
        if out and len(own) < min_cluster:
            out[-1] += own
        else:
            out.append(own)
    return out


def rolling_clusters(df: DataFrame, window: str, group: str, value: str, degree: int, tolerance: float = 0.0) -> DataFrame:
    """window, group, cluster (1: the efficient set) in each window: one more than the longest chain of names above it.
    Curves and pairs of all windows are rows of one job; a task sees a window's names and their pairs, never its rows.
    Rows of overlapping windows come once for each."""
    kinds = dict(df.dtypes)
    rows = df.where(F.col(window).isNotNull())
    edges = dominance(rows, group, value, None, degree, tolerance, [window]).where("dominates").select(window, "x", "y")
    alone = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(window, F.col(group).alias("x"), F.lit(None).cast(kinds[group]).alias("y")).distinct()

    def layers(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names, pairs = set(pdf["x"]), set(pdf.dropna()[["x", "y"]].itertuples(index=False, name=None))
        out, level = [], 0
        while names:
            level += 1
            beaten = {y for x, y in pairs if x in names and y in names}
            own = names - beaten or names
            out += [(key[0], n, level) for n in sorted(own)]
            names -= own
        return pd.DataFrame(out, columns=[window, group, "cluster"])

    return edges.unionByName(alone).groupBy(window).applyInPandas(layers, f"`{window}` {kinds[window]}, `{group}` {kinds[group]}, cluster int")


def turnover(sets: DataFrame, window: str, group: str) -> DataFrame:
    """window, size, turnover: of each window's set, and the share of names of it and the set before that are not in
    both. sets: window, group. Windows are few beside rows."""
    each = sets.groupBy(window).agg(F.collect_set(group).alias("_s"))
    before = F.lag("_s").over(Window.orderBy(window))
    share = 1 - F.size(F.array_intersect("_s", before)) / F.size(F.array_union("_s", before))
    return each.select(window, F.size("_s").alias("size"), share.alias("turnover"))
