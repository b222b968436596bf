"""Named queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailwise.operators import categorical, cells, central, dominance, gaps, grouped, hazard, hypothesis, moments, neighbours, quantile, regression, smoothing, timeseries
from tailwise.operators import causation as causes
from tailwise.sources.tables import table
from tailwise.streaming.windows import windowed_moments

Query = Callable[[SparkSession, str], DataFrame]
KINDS = ["click", "login", "logout", "purchase", "view"]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return put


def items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "lineitem", list(columns))


def events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "events", list(columns))


def _sides(x: str, t: str, d: int) -> tuple[str, str]:
    if d == 0:
        return f"avg(case when {x} <= {t} then 1::double else 0::double end)", f"avg(case when {x} > {t} then 1::double else 0::double end)"
    return f"avg(case when {x} < {t} then ({t} - {x})::double ** {d} when {x} >= {t} then 0::double end)", f"avg(case when {x} > {t} then ({x} - {t})::double ** {d} when {x} <= {t} then 0::double end)"


def _pm_sql() -> str:
    cols = []
    for d in (0, 1, 2, 3):
        low, up = _sides("l_quantity", "m", d)
        ratio = (low, up) if d == 0 else (f"{low} / ({low} + {up})", f"{up} / ({low} + {up})")
        cols += [f"round({e}, 6) as {n}{d}" for e, n in zip((low, up, *ratio), ("lpm", "upm", "lpm_ratio", "upm_ratio"), strict=True)]
    return f"with r as (select l_returnflag, l_quantity, avg(l_quantity) over (partition by l_returnflag) as m from lineitem) select l_returnflag, {', '.join(cols)} from r group by 1"


@query(_pm_sql())
def pm_grouped(spark, d):
    return rounded(moments.partial_moments(items(spark, d, "l_returnflag", "l_quantity"), "l_quantity", [0, 1, 2, 3], ["l_returnflag"]))


TARGETS = [5.0, 20.0, 25.0, 40.0]


@query(
    "select l_returnflag, target, round({0}, 6) as lpm, round({1}, 6) as upm, round({0} / ({0} + {1}), 6) as ratio from lineitem, (values (5.0::double), (20.0), (25.0), (40.0)) t(target) group by 1, 2".format(*_sides("l_quantity", "target", 2))
)
def pm_ratio_targets(spark, d):
    return rounded(moments.ratios_at(items(spark, d, "l_returnflag", "l_quantity"), "l_quantity", TARGETS, 2, ["l_returnflag"]))


@query("select l_returnflag, round({0}, 6) as lpm2, round({1}, 6) as upm2, round({0} / ({0} + {1}), 6) as lpm_ratio2, round({1} / ({0} + {1}), 6) as upm_ratio2 from lineitem group by 1".format(*_sides("l_quantity", "(l_linenumber * 5)::double", 2)))
def pm_moving_target(spark, d):
    li = items(spark, d, "l_returnflag", "l_quantity", "l_linenumber")
    return rounded(moments.partial_moments(li, "l_quantity", [2], ["l_returnflag"], F.col("l_linenumber") * 5))


_MOM = "with r as (select event_type, value as x, avg(value) over (partition by event_type) as m from events), a as (select event_type, avg(x) as mean, avg((x - m) ** 2) as v, avg((x - m) ** 3) as s, avg((x - m) ** 4) as k, count(*)::double as n from r group by 1) "


@query(_MOM + "select event_type, round(mean, 5) as mean, round(v, 5) as variance, round(s / v ** 1.5, 5) as skewness, round(k / v ** 2 - 3, 5) as kurtosis from a")
def moments_population(spark, d):
    return rounded(moments.moments(events(spark, d, "event_type", "value"), "value", ["event_type"]), 5)


@query(
    _MOM + "select event_type, round(mean, 5) as mean, round(v * n / (n - 1), 5) as variance, round(n / ((n - 1) * (n - 2)) * n * s / v ** 1.5, 5) as skewness, round(n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * n * k / (v * n / (n - 1)) ** 2 - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)), 5) as kurtosis from a"
)
def moments_sample(spark, d):
    return rounded(moments.moments(events(spark, d, "event_type", "value"), "value", ["event_type"], False), 5)


_XY = "with r as (select l_returnflag, l_quantity as x, l_extendedprice / 1000 as y, l_discount * 100 as z, avg(l_quantity) over w as mx, avg(l_extendedprice / 1000) over w as my, avg(l_discount * 100) over w as mz from lineitem window w as (partition by l_returnflag)) "


def _xyz(spark, d):
    return items(spark, d, "l_returnflag", "l_quantity", "l_extendedprice", "l_discount").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


_L, _U = ("case when {0} < m{0} then m{0} - {0} when {0} >= m{0} then 0::double end", "case when {0} > m{0} then {0} - m{0} when {0} <= m{0} then 0::double end")


def _co(a: str, b: str) -> str:
    la, lb, ua, ub = _L.format(a), _L.format(b), _U.format(a), _U.format(b)
    return f"round(avg({la} * {lb}), 5) as clpm, round(avg({ua} * {ub}), 5) as cupm, round(avg({ua} * {lb}), 5) as dlpm, round(avg({la} * {ub}), 5) as dupm"


@query(_XY + f"select l_returnflag, {_co('x', 'y')} from r group by 1")
def co_moments(spark, d):
    return rounded(moments.co_moments(_xyz(spark, d), "x", "y", 1, 1, ["l_returnflag"]), 5)


_P3 = "abs(x - mx) * abs(y - my) * abs(z - mz)"
_ND = f"avg(case when x <= mx and y <= my and z <= mz then {_P3} else 0 end) as l, avg(case when x >= mx and y >= my and z >= mz then {_P3} else 0 end) as h, avg(case when not ((x < mx and y < my and z < mz) or (x > mx and y > my and z > mz)) then {_P3} else 0 end) as o"


@query(_XY + f", a as (select l_returnflag, {_ND} from r group by 1) select l_returnflag, round(l / (l + h + o), 6) as co_lpm_nd, round(h / (l + h + o), 6) as co_upm_nd, round(o / (l + h + o), 6) as dpm_nd from a")
def co_moments_nd(spark, d):
    return rounded(moments.co_moments_nd(_xyz(spark, d), ["x", "y", "z"], 1, ["l_returnflag"]))


_CELLS = " union all ".join(f"select l_returnflag, '{a}' as row, '{b}' as col, {_co(a, b)}, round(avg({_U.format(a)} * {_U.format(b)}) + avg({_L.format(a)} * {_L.format(b)}) - avg({_L.format(a)} * {_U.format(b)}) - avg({_U.format(a)} * {_L.format(b)}), 5) as covariance from r group by 1" for a in "xyz" for b in "xyz")


@query(_XY + _CELLS)
def pm_matrix_long(spark, d):
    return rounded(moments.pm_matrix(_xyz(spark, d), ["x", "y", "z"], 1, 1, groups=["l_returnflag"]), 5)


def _copula_sql(cols: str) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    co0 = " + ".join(f"avg(case when ({a} <= m{a}) = ({b} <= m{b}) then 1::double else 0 end)" for a, b in pairs)
    co1 = " + ".join(f"avg({_L.format(a)} * {_L.format(b)} + {_U.format(a)} * {_U.format(b)}) / avg(abs({a} - m{a}) * abs({b} - m{b}))" for a, b in pairs)
    p = " * ".join(f"abs({c} - m{c})" for c in cols)
    every = lambda op: " and ".join(f"{c} {op} m{c}" for c in cols)
    apart = f"not (({every('<')}) or ({every('>')}))"
    d0 = f"avg(case when {apart} then 1::double else 0 end)"
    o, low, high = (f"avg(case when {t} then {p} else 0 end)" for t in (apart, every("<="), every(">=")))
    n = len(cols)
    fc, fd = 0.25 * (n * n - n), 1 - 0.5**n
    return _XY + f"select l_returnflag, round(sqrt((least(abs({co0} - {fc}) / {fc}, 1) + least(abs({co1} - {fc}) / {fc}, 1) + abs({d0} - {fd}) / {fd} + abs({o} / ({o} + {low} + {high}) - {fd}) / {fd}) / 4), 6) as copula from r group by 1"


@query(_copula_sql("xy"))
def copula2(spark, d):
    return rounded(moments.copula(_xyz(spark, d), ["x", "y"], ["l_returnflag"]))


@query(_copula_sql("xyz"))
def copula3(spark, d):
    return rounded(moments.copula(_xyz(spark, d), ["x", "y", "z"], ["l_returnflag"]))


def _run(tab: str, g: str, x: str) -> str:
    return f"with b as (select {g}, {x}::double as v, count(*) as n, sum({x})::double as s, sum({x}::double * {x}) as q from {tab} group by 1, 2), c as (select {g}, v, sum(n) over w as k, sum(s) over w as s1, sum(q) over w as s2, sum(n) over (partition by {g}) as n, sum(s) over (partition by {g}) as t1, sum(q) over (partition by {g}) as t2 from b window w as (partition by {g} order by v)), f as (select *, (v * k - s1) / n as l1, (t1 - s1 - v * (n - k)) / n as u1, (v * v * k - 2 * v * s1 + s2) / n as l2, (v * v * (n - k) - 2 * v * (t1 - s1) + t2 - s2) / n as u2 from c) "


@query(_run("lineitem", "l_returnflag", "l_quantity") + "select l_returnflag, v, round(k::double / n, 6) as CDF from f")
def ecdf(spark, d):
    return rounded(quantile.ecdf(items(spark, d, "l_returnflag", "l_quantity"), "l_quantity", ["l_returnflag"]))


@query(_run("lineitem", "l_returnflag", "l_quantity") + "select l_returnflag, v, round(l1 / (l1 + u1), 6) as CDF from f")
def cdf_deg1(spark, d):
    return rounded(quantile.cdf(items(spark, d, "l_returnflag", "l_quantity"), "l_quantity", 1, ["l_returnflag"]))


@query(_run("lineitem", "l_returnflag", "l_quantity") + "select l_returnflag, v, round(1 - l2 / (l2 + u2), 6) as S from f")
def survival_deg2(spark, d):
    return rounded(quantile.cdf(items(spark, d, "l_returnflag", "l_quantity"), "l_quantity", 2, ["l_returnflag"], "survival"))


@query(_run("lineitem", "l_returnflag", "l_quantity") + "select l_returnflag, v, round(greatest(0, -ln(greatest(1 - k::double / n, 1e-10))), 5) as H from f")
def cumulative_hazard(spark, d):
    return rounded(quantile.cdf(items(spark, d, "l_returnflag", "l_quantity"), "l_quantity", 0, ["l_returnflag"], "cumulative hazard"), 5)


@query("select event_type, round(quantile_cont(value, 0.05), 5) as var from events group by 1")
def var_deg0(spark, d):
    return rounded(quantile.lpm_var(events(spark, d, "event_type", "value"), "value", 0.05, 0, ["event_type"]), 5)


_AT = ", g as (select event_type, arg_max(k, v) as k, arg_max(s1, v) as s1, arg_max(s2, v) as s2, any_value(n) as n, any_value(t1) as t1, any_value(t2) as t2 from f where l{0} / (l{0} + u{0}) <= 0.05 group by 1) "


@query(_run("events", "event_type", "value") + _AT.format(1) + "select event_type, round((0.95 * s1 + 0.05 * (t1 - s1)) / (0.95 * k + 0.05 * (n - k)), 5) as var from g")
def var_deg1(spark, d):
    return rounded(quantile.lpm_var(events(spark, d, "event_type", "value"), "value", 0.05, 1, ["event_type"]), 5)


@query(
    _run("events", "event_type", "value") + _AT.format(2) + ", h as (select event_type, 0.95 * k - 0.05 * (n - k) as a, -2 * (0.95 * s1 - 0.05 * (t1 - s1)) as b, 0.95 * s2 - 0.05 * (t2 - s2) as c from g) select event_type, round((-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a), 5) as var from h"
)
def var_deg2(spark, d):
    return rounded(quantile.lpm_var(events(spark, d, "event_type", "value"), "value", 0.05, 2, ["event_type"]), 5)


@query(_run("events", "event_type", "value") + _AT.format(1).replace("<= 0.05", "<= 0.95") + "select event_type, round((0.05 * s1 + 0.95 * (t1 - s1)) / (0.05 * k + 0.95 * (n - k)), 5) as var from g")
def upm_var_deg1(spark, d):
    return rounded(quantile.upm_var(events(spark, d, "event_type", "value"), "value", 0.05, 1, ["event_type"]), 5)


@query(
    "with recursive e as (select l_returnflag as g, l_quantity as x, count(*) as c from lineitem group by 1, 2), s(g, i, a, b) as (select g, 0, min(x), max(x) from e group by 1 union all select s.g, any_value(i) + 1, any_value(case when ok then t else a end), any_value(case when ok then b else t end) from (select s.g, i, a, b, (a + b) / 2 as t, (select sum(c * greatest(0, (a + b) / 2 - x) ** 3) * 0.75 <= sum(c * greatest(0, x - (a + b) / 2) ** 3) * 0.25 from e where e.g = s.g) as ok from s where i < 60) s group by s.g) select g as l_returnflag, round(any_value(a), 5) as var from s where i = 60 group by 1"
)
def var_deg3(spark, d):
    return rounded(quantile.lpm_var(items(spark, d, "l_returnflag", "l_quantity"), "l_quantity", 0.25, 3, ["l_returnflag"]), 5)


_MONTHS = "p as (select o_orderpriority as g, date_trunc('month', o_orderdate) as t, avg(o_totalprice) / 1000 as x, count(*)::double as y from orders group by 1, 2), k as (select row_number() over (order by g, t) as id, x, y from p)"


def _months(spark, d):
    o = table(spark, d, "orders", ["o_orderpriority", "o_orderdate", "o_totalprice"])
    m = o.groupBy(F.col("o_orderpriority").alias("g"), F.date_trunc("month", "o_orderdate").alias("t")).agg((F.avg("o_totalprice") / 1000).alias("x"), F.count("*").cast("double").alias("y"))
    return m.withColumn("id", F.row_number().over(Window.orderBy("g", "t")).cast("long"))


@query(f"with {_MONTHS} select a.id, round(avg(case when b.x <= a.x and b.y <= a.y then 1::double else 0 end), 6) as value from k a, k b group by 1")
def cdf_multivariate(spark, d):
    m = _months(spark, d)
    return rounded(quantile.cdf_nd(m, ["x", "y"], m, "id"))


_CO1 = "abs(b.x - a.x) * abs(b.y - a.y)"
_SHARE = "avg(greatest(0, a.{0} - b.{0})) / nullif(avg(abs(b.{0} - a.{0})), 0)"


@query(
    f"with {_MONTHS}, c as (select a.id, avg(case when b.x <= a.x and b.y <= a.y then {_CO1} else 0 end) as l, avg(case when b.x >= a.x and b.y >= a.y then {_CO1} else 0 end) as h, avg(case when not ((b.x < a.x and b.y < a.y) or (b.x > a.x and b.y > a.y)) then {_CO1} else 0 end) as o, {_SHARE.format('x')} as rx, {_SHARE.format('y')} as ry from k a, k b group by 1) select id, round(least(1, greatest(0, 1 - rx - ry + coalesce(l / nullif(l + h + o, 0), 0))), 6) as value from c"
)
def survival_multivariate(spark, d):
    m = _months(spark, d)
    return rounded(quantile.cdf_nd(m, ["x", "y"], m, "id", 1, "survival"))


def _cdf3_sql(degree: int) -> str:
    u = lambda c: f"(b.{c} - a.{c})"
    p = " * ".join(f"abs({u(c)}) ** {degree}" for c in "xyz") if degree else "1::double"
    low = " and ".join(f"b.{c} <= a.{c}" for c in "xyz")
    return f"with {_MONTHS}, z as (select id, x, y, x * ((id * 7) % 5) as z from k) select a.id, round(sum(case when {low} then {p} else 0 end) / sum({p}), 6) as value from z a, z b group by 1"


def _months3(spark, d):
    return _months(spark, d).withColumn("z", F.col("x") * ((F.col("id") * 7) % 5))


@query(_cdf3_sql(0))
def cdf_three_columns(spark, d):
    m = _months3(spark, d)
    return rounded(quantile.cdf_nd(m, ["x", "y", "z"], m, "id"))


@query(_cdf3_sql(2))
def cdf_three_columns_deg2(spark, d):
    m = _months3(spark, d)
    return rounded(quantile.cdf_nd(m, ["x", "y", "z"], m, "id", 2))


_AT_TARGETS = """with t as (select distinct o_totalprice / 1e4 as target from orders), g as (select distinct l_returnflag as f from lineitem),
b as (select l_returnflag as f, l_quantity::double - 25 as v, count(*)::double as n from lineitem group by 1, 2),
c as (select f, v, sum(n) over w as n0, sum(n * v) over w as n1, sum(n * v * v) over w as n2, sum(n * v * v * v) over w as n3, sum(n) over p as t0, sum(n * v) over p as t1, sum(n * v * v) over p as t2, sum(n * v * v * v) over p as t3 from b window w as (partition by f order by v), p as (partition by f)),
j as (select g.f, t.target, t.target - 25 as a, coalesce(n0, 0) as n0, coalesce(n1, 0) as n1, coalesce(n2, 0) as n2, coalesce(n3, 0) as n3 from t cross join g asof left join c on c.f = g.f and c.v <= t.target - 25),
k as (select j.*, s.* exclude (f) from j join (select f, any_value(t0) as t0, any_value(t1) as t1, any_value(t2) as t2, any_value(t3) as t3 from c group by 1) s on s.f = j.f),
r as (select f, target, t0, n0 / t0 as l0, (a * n0 - n1) / t0 as l1, (t1 - n1 - a * (t0 - n0)) / t0 as u1, greatest(0, a ** 3 * n0 - 3 * a * a * n1 + 3 * a * n2 - n3) / t0 as l3, greatest(0, t3 - n3 - 3 * a * (t2 - n2) + 3 * a * a * (t1 - n1) - a ** 3 * (t0 - n0)) / t0 as u3 from k)
"""


def _price_targets(spark, d):
    flags = items(spark, d, "l_returnflag").distinct()
    return flags.join(table(spark, d, "orders", ["o_totalprice"]).select((F.col("o_totalprice") / 1e4).alias("target")).distinct())


@query(_AT_TARGETS + "select f as l_returnflag, round(target, 6) as target, round(l0, 6) as lpm0, round(l1, 5) as lpm1, round(u1, 5) as upm1, round(u3, 3) as upm3, round(l3 / (l3 + u3), 6) as lpm_ratio3 from r")
def pm_target_table(spark, d):
    """A table of targets (the orders' prices) for each flag, in one sort."""
    found = quantile.partial_moments_at(items(spark, d, "l_returnflag", "l_quantity"), "l_quantity", _price_targets(spark, d), "target", [0, 1, 3], ["l_returnflag"])
    return found.select("l_returnflag", F.round("target", 6).alias("target"), F.round("lpm0", 6).alias("lpm0"), *[F.round(c, 5).alias(c) for c in ("lpm1", "upm1")], F.round("upm3", 3).alias("upm3"), F.round("lpm_ratio3", 6).alias("lpm_ratio3"))


@query(_AT_TARGETS + ", e as (select l_returnflag as f, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by 1) select r.f as l_returnflag, round(target, 6) as target, case when target between lo and hi then round(1 - l3 / (l3 + u3), 6) end as S from r join e on e.f = r.f")
def survival_deg3_at_targets(spark, d):
    return rounded(quantile.cdf_at(items(spark, d, "l_returnflag", "l_quantity"), "l_quantity", _price_targets(spark, d), "target", 3, ["l_returnflag"], "survival"))


@query(_XY + f"select l_returnflag, round(avg({_L.format('x')} * case when y <= my then 1::double else 0 end), 5) as clpm, round(avg({_U.format('x')} * case when y > my then 1::double else 0 end), 5) as cupm from r group by 1")
def co_moments_two_degrees(spark, d):
    return rounded(moments.co_moments(_xyz(spark, d), "x", "y", 1, 1, ["l_returnflag"], degree_y=0).select("l_returnflag", "clpm", "cupm"), 5)


@query("with c as (select o_orderstatus, count(*) as n from orders group by 1) select o_orderstatus, (select min(n) from c) as down, (select max(n) from c) as up from c")
def balanced_classes(spark, d):
    o = table(spark, d, "orders", ["o_orderkey", "o_orderstatus"])
    down, up = (f(o, "o_orderstatus", 1, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias(n)) for f, n in ((categorical.down_sample, "down"), (categorical.up_sample, "up")))
    return down.join(up, "o_orderstatus")


_GRAV = """with r as (select event_type, value as v, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events),
s as (select event_type, any_value(n) as n, min(v) as lo, max(v) as hi, avg(v) as m,
  max(case when i = greatest(1, floor(n * 0.25)) then v end) as f1, max(case when i = greatest(1, floor(n * 0.5)) then v end) as f2, max(case when i = greatest(1, floor(n * 0.75)) then v end) as f3,
  max(case when i = greatest(1, ceil(n * 0.25)) then v end) as c1, max(case when i = greatest(1, ceil(n * 0.5)) then v end) as c2, max(case when i = greatest(1, ceil(n * 0.75)) then v end) as c3 from r group by 1),
q as (select *, case when n % 2 = 0 then f1 else f1 + (n * 0.25 - floor(n * 0.25)) * (c1 - f1) end as q1, case when n % 2 = 0 then f2 else (f2 + c2) / 2 end as q2, case when n % 2 = 0 then f3 else f3 + (n * 0.75 - floor(n * 0.75)) * (c3 - f3) end as q3 from s),
w as (select *, (q3 - q1) / sqrt(n::double) as w, floor((hi - lo) / ((q3 - q1) / sqrt(n::double)) + 1e-12) as last from q),
b as (select r.event_type, least(floor((v - lo) / w), last) as bin, count(*) as c from r join w using (event_type) group by 1, 2),
t as (select event_type, max(c) as top, arg_max(bin, c) as peak from b group by 1),
u as (select b.event_type, sum(case when c = top then 1 else 0 end) as ties, sum((lo + bin * w) * c) / sum(c) as allbins, sum(case when abs(bin - peak) <= 1 then (lo + bin * w) * c end) / sum(case when abs(bin - peak) <= 1 then c end) as near from b join t using (event_type) join w using (event_type) group by 1)
select event_type, round(0.25 * (q2 + case when ties = 1 then near else allbins end + m + 0.5 * (q1 + q3)), 5) as gravity from w join u using (event_type)"""


@query(_GRAV)
def gravity(spark, d):
    return rounded(central.gravity(events(spark, d, "event_type", "value"), "value", ["event_type"]), 5)


@query("with c as (select event_type, floor(value + 0.5)::bigint as v, count(*) as c from events group by 1, 2), t as (select *, max(c) over (partition by event_type) as top from c) select event_type, round(avg(v), 6) as mode from t where c = top group by 1")
def mode_discrete(spark, d):
    return rounded(central.mode_discrete(events(spark, d, "event_type", "value"), "value", ["event_type"]))


@query("with b as (select event_type, min(value) as lo, max(value) as hi from events group by 1) select event_id, round(-1 + 2 * (value - lo) / (hi - lo), 6) as rescaled from events join b using (event_type)")
def rescale_minmax(spark, d):
    return rounded(central.rescale_minmax(events(spark, d, "event_id", "event_type", "value"), "value", -1, 1, ["event_type"]).select("event_id", "rescaled"))


@query("with b as (select event_type, avg(value) as m from events group by 1) select event_id, round(value * 100 * exp(0.05 * 0.5) / m, 5) as rescaled from events join b using (event_type)")
def rescale_riskneutral(spark, d):
    return rounded(central.rescale_riskneutral(events(spark, d, "event_id", "event_type", "value"), "value", 100, 0.05, 0.5, groups=["event_type"]).select("event_id", "rescaled"), 5)


def _norm_sql(linear: bool) -> str:
    m = {c: f"(select avg({e}) from lineitem)" for c, e in (("x", "l_quantity"), ("y", "l_extendedprice / 1000"), ("z", "l_discount * 100"))}
    e = {"x": "l_quantity", "y": "l_extendedprice / 1000", "z": "l_discount * 100"}
    w = lambda a, b: "1" if linear or a == b else f"(select abs(corr({e[a]}, {e[b]})) from lineitem)"
    return " union all ".join(f"select '{c}' as column, round(({' + '.join(f'{m[a]} / {m[c]} * {w(a, c)}' for a in 'xyz')}) / 3, 6) as scale" for c in "xyz").replace("as column,", 'as "column",')


@query(_norm_sql(True))
def norm_linear(spark, d):
    return rounded(cells.norm_scales(_xyz(spark, d), ["x", "y", "z"], True))


@query(_norm_sql(False))
def norm_corr(spark, d):
    return rounded(cells.norm_scales(_xyz(spark, d), ["x", "y", "z"]))


_PAIRS = "p as (select a.event_type as x, b.event_type as y from (select distinct event_type from events) a, (select distinct event_type from events) b where a.event_type <> b.event_type)"
_KIND = "event_type in ('" + "', '".join(KINDS) + "')"


def _kinds(spark, d):
    return sorted(r[0] for r in events(spark, d, "event_type").distinct().collect())


@query(
    f"with {_PAIRS}, c as (select event_type as t, value as v, count(*)::double as n from events group by 1, 2), k as (select *, sum(n) over (partition by t order by v) as le, sum(n) over (partition by t) as n_all from c), j as (select p.x, p.y, a.n, a.n_all, coalesce(b.le, 0) as le, coalesce(b.n, 0) as tie0, b.v as bv, a.v as av from p join k a on a.t = p.x asof left join k b on b.t = p.y and b.v <= a.v), s as (select j.x, j.y, sum(j.n * (le - case when bv = av then tie0 else 0 end)) / any_value(j.n_all) as g, sum(j.n * case when bv = av then tie0 else 0 end) / any_value(j.n_all) as e from j group by 1, 2) select s.x, s.y, round(g / m, 6) as p_gt, round(e / m, 6) as p_tie, round(g / m + 0.5 * e / m, 6) as p_star from s join (select event_type, count(*) as m from events group by 1) z on z.event_type = s.y"
)
def superiority(spark, d):
    return rounded(dominance.superiority(events(spark, d, "event_type", "value"), "event_type", "value", _kinds(spark, d)))


def _dom_sql(degree: int) -> str:
    dev = {1: "case when e.value <= g.v then 1::double else 0 end", 2: "greatest(0::double, g.v - e.value)", 3: "greatest(0::double, g.v - e.value) ** 2"}[degree]
    mean = "" if degree == 1 else " and x.m >= y.m"
    return f"with e as (select l_returnflag as t, l_quantity::double as value from lineitem), g as (select distinct value as v from e), c as (select t, v, avg({dev}) as l from e, g group by 1, 2), s as (select t, min(value) as lo, avg(value) as m from e group by 1) select a.t as x, b.t as y, coalesce(bool_or(abs(a.l - b.l) > 1e-9 * abs(b.l)) and not bool_or(a.l - b.l > 1e-9 * abs(b.l)) and any_value(x.lo >= y.lo{mean}), false) as dominates from c a join c b on a.v = b.v and a.t <> b.t join s x on x.t = a.t join s y on y.t = b.t group by 1, 2"


def _flags(spark, d, degree):
    li = items(spark, d, "l_returnflag", "l_quantity")
    names = sorted(r[0] for r in li.select("l_returnflag").distinct().collect())
    return dominance.dominance(li, "l_returnflag", "l_quantity", names, degree, 1e-9)


@query(_dom_sql(1))
def fsd_pairs(spark, d):
    return _flags(spark, d, 1)


@query(_dom_sql(2))
def ssd_pairs(spark, d):
    return _flags(spark, d, 2)


@query(_dom_sql(3))
def tsd_pairs(spark, d):
    return _flags(spark, d, 3)


_RUNS = _run("events", "event_type", "value").removeprefix("with ").rstrip()


def _ssd_sql() -> str:
    return f"with {_RUNS}, ev as (select event_type as t, value::double as value from events), gv as (select distinct v from f), cv as (select n.t, gv.v, gv.v * coalesce(a.k, 0) - coalesce(a.s1, 0) as up from gv cross join (select distinct t from ev) n asof left join (select event_type as t, v, k, s1 from f) a on a.t = n.t and a.v <= gv.v), lv as (select cv.t, cv.v, cv.up / z.n as l from cv join (select event_type as t, any_value(n) as n from f group by 1) z on z.t = cv.t), sv as (select t, min(value) as lo, avg(value) as m, avg(((select max(value) from events) - value) ** 2) as top from ev group by 1), dom as (select a.t as x, b.t as y from lv a join lv b on a.v = b.v and a.t <> b.t join sv x on x.t = a.t join sv y on y.t = b.t group by 1, 2 having bool_or(abs(a.l - b.l) > 1e-9 * abs(b.l)) and not bool_or(a.l - b.l > 1e-9 * abs(b.l)) and any_value(x.lo >= y.lo and x.m >= y.m))"


@query(_ssd_sql() + " select (row_number() over (order by top, t) - 1)::int as place, t as event_type from sv where t not in (select y from dom)")
def efficient_set(spark, d):
    # Dominance is transitive, so what the set keeps is what nothing dominates.
    names = dominance.efficient_set(events(spark, d, "event_type", "value"), "event_type", "value", _kinds(spark, d), 2, 1e-9)
    return spark.createDataFrame([(k, n) for k, n in enumerate(names)], "place int, event_type string")


@query(_ssd_sql().replace("with ", "with recursive ", 1) + ", rv(t, depth) as (select t, 1 from sv union select dom.y, depth + 1 from rv join dom on dom.x = rv.t) select max(depth)::int as cluster, t as event_type from rv group by t")
def sd_cluster(spark, d):
    found = dominance.clusters(events(spark, d, "event_type", "value"), "event_type", "value", _kinds(spark, d), 2, tolerance=1e-9)
    return spark.createDataFrame([(k + 1, n) for k, own in enumerate(found) for n in own], "cluster int, event_type string")


_DAY = "s as (select o_orderpriority as g, date_trunc('month', o_orderdate) as t, avg(o_totalprice) / 1000 as x from orders group by 1, 2), r as (select g, x, row_number() over (partition by g order by t) as i, count(*) over (partition by g) as n from s) "


def _monthly(spark, d):
    o = table(spark, d, "orders", ["o_orderpriority", "o_orderdate", "o_totalprice"])
    return o.groupBy(F.col("o_orderpriority").alias("g"), F.date_trunc("month", "o_orderdate").alias("t")).agg((F.avg("o_totalprice") / 1000).alias("x"))


@query(
    "with " + _DAY + ", b as (select g, abs(stddev_samp(x) / avg(x)) as base, any_value(n) as n from r group by 1), e as (select r.g, p.p as period, s.s, abs(stddev_samp(x) / avg(x)) as c from r, (select unnest(range(1, 200)) as p) p, (values (0), (1), (2)) s(s) where p.p <= r.n // 2 and r.n - r.i - s.s >= 0 and (r.n - r.i - s.s) % p.p = 0 group by 1, 2, 3), k as (select g, period, max(coalesce(c, base)) as most, avg(coalesce(c, base)) as cv, any_value(base) as base, any_value(n) as n from e join b using (g) group by 1, 2) select g, period, round(cv, 6) as cv, round(base, 6) as baseline from k where most <= base * (1 + 1e-12) and period < n / 2"
)
def seasonality(spark, d):
    return rounded(timeseries.seasonality(_monthly(spark, d), "x", "t", ["g"]))


@query("with " + _DAY + "select g, step, round(greatest(0, forecast), 5) as forecast from (select g, c, unnest(case when c = 0 then [1, 13] else [c + 1] end) as step, mx + coalesce(b, 0) * ((step - 1) // 12 - mm) as forecast from (select g, ((i - n - 1) % 12 + 12) % 12 as c, avg(x) as mx, regr_slope(x, floor((i - n - 1) / 12.0)) as b, avg(floor((i - n - 1) / 12.0)) as mm from r group by 1, 2)) where step <= 13")
def linear_static_arma(spark, d):
    return rounded(timeseries.linear_static(_monthly(spark, d), "x", "t", 12, 13, ["g"]), 5)


@query("with " + _DAY + ", l as (select g, i, x, lag(x, 1) over w as a, lag(x, 2) over w as b from r window w as (partition by g order by i)) select g, round(x, 5) as x_tau_0, round(a, 5) as x_tau_1, round(b, 5) as x_tau_2 from l where i > 2")
def lag_matrix(spark, d):
    return rounded(timeseries.lag_matrix(_monthly(spark, d), ["x"], "t", 2, ["g"]).drop("t"), 5)


@query(
    "with e as (select date_trunc('day', ts) as day, value, avg(value) over (partition by date_trunc('day', ts)) as m from events), r as (select day, sqrt(avg(greatest(0, value - m) ** 2)) / sqrt(avg(greatest(0, m - value) ** 2)) as ratio from e group by 1) select day, round(ratio, 6) as ratio, round(avg(ratio) over (order by day rows between 6 preceding and current row), 6) as signal from r"
)
def rolling_dispersion(spark, d):
    e = events(spark, d, "ts", "value").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "value")
    return rounded(timeseries.rolling_dispersion(moments.with_group_means(e, ["value"], ["day"]), "value", "day", "mean_value", 7))


def _anova_sql(pairwise: bool, medians: bool, means_only: bool) -> str:
    tails = {"u25": 0.75, "l25": 0.25, "u125": 0.875, "l125": 0.125}
    at = lambda p: f"select event_type, ({1 - p} * s1 + {p} * (t1 - s1)) / ({1 - p} * k + {p} * (n - k)) as t from (select event_type, arg_max(k, v) as k, arg_max(s1, v) as s1, any_value(n) as n, any_value(t1) as t1 from f where l1 / (l1 + u1) <= {p} group by 1)"
    centre = "quantile_cont(value, 0.5)" if medians else "avg(value)"
    each = f"each as (select g.event_type as g, g.n, g.m, {', '.join(f'{k}.t as {k}' for k in tails)} from (select event_type, count(*)::double as n, {centre} as m from events group by 1) g " + " ".join(f"join v_{k} {k} on {k}.event_type = g.event_type" for k in tails) + ")"
    grand = "(a.n * a.m + b.n * b.m) / (a.n + b.n)" if pairwise else "(select avg(m) from each)"
    target = lambda k: f"(a.{k} + b.{k}) / 2" if pairwise else f"(select avg({k}) from each)"
    pairs = f"pairs as (select a.g as a, b.g as b, a.n + b.n as n, a.m as control, b.m as treatment, {grand} as t_m, {', '.join(f'{target(k)} as t_{k}' for k in tails)} from each a join each b on a.g < b.g)"
    ratio = lambda low, t: f"avg(greatest(0, {f'{t} - value' if low else f'value - {t}'})) / avg(abs(value - {t}))"
    cdf = "avg(case when value <= t_m then 1::double else 0 end)" if medians else ratio(True, "t_m")
    side = lambda s: f"{s} as (select p.a, p.b, {cdf} as cdf, {', '.join(f'{ratio(k[0] == chr(108), f"t_{k}")} as {k}' for k in tails)} from pairs p join events e on e.event_type = p.{s[1]} group by 1, 2)"
    share = lambda k, p: f"(({p} - least({p}, greatest(abs(x.{k} - {p}), abs(y.{k} - {p})))) / {p}) ** 2"
    rho = share("cdf", 0.5)
    if not means_only:
        rho = f"({rho} + 0.5 * {share('u25', 0.25)} + 0.5 * {share('l25', 0.25)} + 0.25 * {share('u125', 0.125)} + 0.25 * {share('l125', 0.125)}) / 2.5"
    return f"with {_RUNS}, {', '.join(f'v_{k} as ({at(p)})' for k, p in tails.items())}, {each}, {pairs}, {side('sa')}, {side('sb')}, done as (select p.a, p.b, control, treatment, t_m as grand, x.cdf as control_cdf, y.cdf as treatment_cdf, least(1, {rho} * ((n - 2) / n) ** 2) as certainty from pairs p join sa x on x.a = p.a and x.b = p.b join sb y on y.a = p.a and y.b = p.b) "


_ANOVA = ", ".join(f"round({c}, 6) as {c}" for c in ("control", "treatment", "grand", "control_cdf", "treatment_cdf", "certainty"))


@query(_anova_sql(True, False, False) + f"select {_ANOVA} from done order by a, b limit 1")
def anova_two(spark, d):
    kinds = _kinds(spark, d)
    return rounded(hypothesis.anova_pair(events(spark, d, "event_type", "value"), "event_type", "value", kinds[0], kinds[1]), 6)


@query(_anova_sql(True, False, False) + f"select a, b, {_ANOVA} from done")
def anova_pairwise(spark, d):
    return rounded(hypothesis.anova(events(spark, d, "event_type", "value"), "event_type", "value"))


@query(_anova_sql(False, False, False) + "select round(avg(certainty), 6) as certainty from done")
def anova_groups(spark, d):
    return rounded(hypothesis.anova_all(events(spark, d, "event_type", "value"), "event_type", "value"))


@query(_anova_sql(False, True, True) + f"select a, b, {_ANOVA} from done")
def anova_medians_only(spark, d):
    return rounded(hypothesis.anova(events(spark, d, "event_type", "value"), "event_type", "value", False, True, True))


FLAGS = ["R", "N", "A"]


@query("select l_returnflag, l_linestatus, case l_returnflag when 'R' then 1::double when 'N' then 2 when 'A' then 3 end as code, case when l_returnflag = 'N' then 1::double else 0 end as l_returnflag_N, case when l_returnflag = 'A' then 1::double else 0 end as l_returnflag_A, count(*) as n from lineitem group by all")
def factor_codes(spark, d):
    li = items(spark, d, "l_returnflag", "l_linestatus")
    df = categorical.dummies(li, "l_returnflag", FLAGS).withColumn("code", categorical.factor_code("l_returnflag", FLAGS))
    return df.groupBy("l_returnflag", "l_linestatus", "code", "l_returnflag_N", "l_returnflag_A").agg(F.count("*").alias("n"))


@query("select r_name, n_name, round(avg(greatest(0::double, 1000 - c_acctbal)), 4) as lpm1, round(avg(greatest(0::double, c_acctbal - 1000)), 4) as upm1 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def pm_rollup(spark, d):
    c = table(spark, d, "customer", ["c_nationkey", "c_acctbal"])
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    df = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    from tailwise.functions.expr import lpm, upm

    return rounded(df.rollup("r_name", "n_name").agg(lpm("c_acctbal", 1000, 1).alias("lpm1"), upm("c_acctbal", 1000, 1).alias("upm1")), 4)


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(avg(greatest(0, 100 - value)), 5) as lpm1, round(avg(greatest(0, value - 100)), 5) as upm1 from events group by 1, 2")
def windowed_pm(spark, d):
    w = windowed_moments(events(spark, d, "ts", "event_type", "value"), "ts", "value", 100, "1 day", keys=["event_type"])
    return rounded(w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "lpm1", "upm1"), 5)


@query()
def dependence(spark, d):
    return rounded(cells.dependence(_xyz(spark, d), "x", "y", ["l_returnflag"]))


@query()
def causation(spark, d):
    return rounded(causes.causation(_monthly(spark, d).withColumn("y", F.col("x") * F.month("t")), "x", "y", "t", ["g"], 1))


@query()
def causal_matrix(spark, d):
    li = items(spark, d, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), (F.col("l_quantity") + 0.5).alias("quantity"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))
    return rounded(causes.causal_matrix(rows, ["quantity", "price", "paid"], 0, "o"))


@query()
def causation_permutations(spark, d):
    return rounded(causes.permutation_test(_monthly(spark, d).withColumn("y", F.col("x") * F.month("t")), "x", "y", "t", ["g"], 1, 20))


@query()
def filled_gaps(spark, d):
    m, month = _monthly(spark, d), F.month("t")
    series = m.select("g", "t", F.when(month % 5 != 3, F.col("x")).alias("x"), F.when(month % 4 != 1, F.col("x") * month).alias("y"))
    return rounded(gaps.fill_gaps(series, ["x", "y"], "t", ["g"]).withColumn("t", F.col("t").cast("timestamp_ntz")))


@query()
def dependence_matrix(spark, d):
    return rounded(cells.pair_matrix(_xyz(spark, d), ["x", "y", "z"]))


def _partition_sql(rounds: int) -> str:
    """Unrolled rounds of the partition at means; a group stops after a round that leaves a cell of 8 rows or fewer."""
    ctes = ["r0 as (select row_number() over () as id, l_returnflag as g, l_quantity as x, l_extendedprice / 1000 as y, 'q' as c, 'pq' as p, true as go from lineitem)"]
    for k in range(rounds):
        ctes.append(f"m{k} as (select *, count(*) over w as n, avg(x) over w as cx, avg(y) over w as cy from r{k} window w as (partition by g, c))")
        ctes.append(f"s{k} as (select id, g, x, y, case when go and n > 8 then c || (1 + (x <= cx)::int + 2 * (y <= cy)::int) else c end as c, case when go and n > 8 then c else p end as p, go and max(n) over (partition by g) > 8 as go from m{k})")
        ctes.append(f"t{k} as (select *, count(*) over (partition by g, c) as n from s{k})")
        ctes.append(f"r{k + 1} as (select id, g, x, y, c, p, go and min(n) over (partition by g) > 8 as go from t{k})")
    return "with " + ", ".join(ctes) + f" select g as l_returnflag, round(x, 6) as x, round(y, 6) as y, c as quadrant, p as prior from r{rounds}"


@query(_partition_sql(16))
def partition_map(spark, d):
    return rounded(cells.partition(_xyz(spark, d), "x", "y", ["l_returnflag"], centre="mean"))


@query(_partition_sql(4))
def partition_map_order4(spark, d):
    return rounded(cells.partition(_xyz(spark, d), "x", "y", ["l_returnflag"], centre="mean", order=4))


@query()
def partition_points(spark, d):
    return rounded(cells.partition(_xyz(spark, d), "x", "y", ["l_returnflag"], points=True))


@query()
def mode_continuous(spark, d):
    return rounded(grouped.mode(events(spark, d, "event_type", "value"), "value", ["event_type"]))


@query()
def arma_recursive(spark, d):
    return rounded(grouped.forecast(_monthly(spark, d), "x", "t", ["g"], 6, [3, 12]))


@query()
def monte_carlo(spark, d):
    return grouped.monte_carlo(_monthly(spark, d), "x", "t", ["g"], 10, [-1.0, 0.0, 0.5, 1.0])


_GAP = "abs(c.{0} - s.{0}) / nullif(greatest(hi_{0}, c.{0}) - least(lo_{0}, c.{0}), 0)"
_GAPS = [f"coalesce({_GAP.format(f)}, 0)" for f in "ab"]


@query(
    "with s as (select s_suppkey, s_acctbal::double as a, s_nationkey::double as b from supplier), c as (select c_custkey, c_acctbal::double as a, c_nationkey::double as b from customer), r as (select min(a) as lo_a, max(a) as hi_a, min(b) as lo_b, max(b) as hi_b from s), "
    f"d as (select c_custkey, s_suppkey, {' + '.join(f'{g} * {g} + {g}' for g in _GAPS)} as d from c, s, r) select c_custkey, arg_min(s_suppkey, struct_pack(d := d, k := s_suppkey))::double as prediction from d group by 1"
)
def nearest_supplier(spark, d):
    """For each customer the supplier nearest by balance and nation; ties to the smaller number."""
    s = table(spark, d, "supplier", ["s_suppkey", "s_acctbal", "s_nationkey"]).select("s_suppkey", F.col("s_acctbal").alias("a"), F.col("s_nationkey").alias("b"))
    c = table(spark, d, "customer", ["c_custkey", "c_acctbal", "c_nationkey"]).select("c_custkey", F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"))
    return neighbours.nearest(s, c, ["a", "b"], "s_suppkey", "c_custkey", 1, order="s_suppkey")


@query()
def nearest_points(spark, d):
    li = _xyz(spark, d)
    points = li.where("l_returnflag = 'A'").groupBy("x").agg(F.avg("z").alias("z"), F.avg("y").alias("y"))
    asked = li.where("l_returnflag <> 'A'").groupBy("x").agg(F.avg("z").alias("z")).withColumn("id", F.col("x").cast("long"))
    return rounded(neighbours.nearest(points, asked, ["x", "z"], "y", "id", 5))


@query()
def regression_segments(spark, d):
    return rounded(regression.fit_regression(_monthly(spark, d).withColumn("i", F.month("t")), "i", "x", ["g"]))


@query()
def regression_fit(spark, d):
    m = _monthly(spark, d).withColumn("i", F.month("t"))
    return rounded(grouped.score_regression(m, "i", regression.fit_regression(m, "i", "x", ["g"]), ["g"]))


@query()
def hazard_by_type(spark, d):
    return rounded(hazard.hazard(events(spark, d, "event_type", "value"), "value", 1, ["event_type"]), 5)


@query()
def smoothing_spline(spark, d):
    li = items(spark, d, "l_returnflag", "l_quantity", "l_extendedprice")
    at = li.select("l_returnflag", "l_quantity").distinct()
    return rounded(smoothing.score_pieces(at, "l_quantity", smoothing.smoothing_spline(li, "l_quantity", "l_extendedprice", ["l_returnflag"], 0.6), ["l_returnflag"]), 4)


@query()
def smooth_regression(spark, d):
    m = _monthly(spark, d).withColumn("i", F.months_between("t", F.lit("1990-01-01")))
    return rounded(smoothing.score_pieces(m, "i", regression.fit_smooth(m, "i", "x", ["g"]), ["g"]), 4)


@query()
def arma_nonlinear(spark, d):
    return rounded(grouped.forecast_nonlinear(_monthly(spark, d), "x", "t", ["g"], 4, [12]))


def _panel(spark, d):
    """Months of each priority with three features."""
    return _months(spark, d).select("id", "g", F.month("t").cast("double").alias("month"), F.months_between("t", F.lit("1990-01-01")).alias("time"), "y", "x")


_FEATURES = ["month", "time", "y"]


@query()
def surface_regression(spark, d):
    return rounded(grouped.fitted_by(_panel(spark, d), _FEATURES, "x", "id", ["g"], confidence=0.95))


@query()
def line_regression(spark, d):
    m = _panel(spark, d)
    return rounded(grouped.predict_by(m, m.withColumn("time", F.col("time") + 1), _FEATURES, "x", "id", ["g"], "line"))


@query()
def stacked_regression(spark, d):
    m = _panel(spark, d)
    return rounded(grouped.predict_by(m, m.where("month = 12").withColumn("time", F.col("time") + 12), _FEATURES, "x", "id", ["g"], "stack"))


@query()
def boosted_shares(spark, d):
    return rounded(grouped.feature_shares(_panel(spark, d), _FEATURES, "x", ["g"]))


@query()
def boosted_regression(spark, d):
    m = _panel(spark, d)
    return rounded(grouped.predict_by(m, m.where("month = 12"), _FEATURES, "x", "id", ["g"], "boost"))


@query()
def arma_best(spark, d):
    return rounded(grouped.forecast_best(_monthly(spark, d), "x", "t", ["g"], 6, [2, 3, 6, 12]))


@query()
def regression_intervals(spark, d):
    m = _monthly(spark, d).withColumn("i", F.month("t"))
    return rounded(grouped.regression_table(m, "i", "x", regression.fit_regression(m, "i", "x", ["g"]), ["g"]))


@query()
def overall_slope(spark, d):
    m = _monthly(spark, d).withColumn("i", F.month("t"))
    return rounded(grouped.mean_slope(m, "i", regression.fit_regression(m, "i", "x", ["g"]), ["g"]))


_WEEKS = (
    "e as (select date_trunc('week', ts) as week, event_type as t, value as v from events), n as (select week, t, count(*)::double as n, min(v) as lo from e group by 1, 2), g as (select distinct week, v from e), "
    "c as (select g.week, n.t, g.v, count(e.v) / n.n as f from g join n using (week) left join e on e.week = g.week and e.t = n.t and e.v <= g.v group by g.week, n.t, g.v, n.n), "
    "dom as (select a.week, a.t as x, b.t as y from c a join c b on a.week = b.week and a.v = b.v and a.t <> b.t join n p on p.week = a.week and p.t = a.t join n q on q.week = b.week and q.t = b.t group by 1, 2, 3 having bool_or(abs(a.f - b.f) > 1e-9 * abs(b.f)) and not bool_or(a.f - b.f > 1e-9 * abs(b.f)) and any_value(p.lo >= q.lo)), "
    "rv(week, t, depth) as (select week, t, 1 from n union select dom.week, dom.y, depth + 1 from rv join dom on dom.week = rv.week and dom.x = rv.t), sets as (select week, t as event_type, max(depth)::int as cluster from rv group by 1, 2)"
)


@query(f"with recursive {_WEEKS} select * from sets")
def rolling_sets(spark, d):
    e = events(spark, d, "ts", "event_type", "value").withColumn("week", F.date_trunc("week", "ts").cast("timestamp_ntz"))
    return dominance.rolling_clusters(e, "week", "event_type", "value", 1, 1e-9)


@query(
    f"with recursive {_WEEKS}, s as (select week, list(event_type) as own from sets where cluster = 1 group by 1), b as (select week, own, lag(own) over (order by week) as old from s) select week, len(own)::int as size, round(1 - len(list_intersect(own, old)) / len(list_distinct(own || old)), 6) as turnover from b"
)
def set_turnover(spark, d):
    return rounded(dominance.turnover(rolling_sets(spark, d).where("cluster = 1"), "week", "event_type"))


_STRESS = "with s as (select l_tax * 100 - 4 as a, l_quantity - 25 as b, l_discount * 100 - 5 as m from lineitem where l_discount * 100 - 5 <= -1) "


@query(_STRESS + " union all ".join(f"select '{c}' as asset, {k} as degree, round(avg(greatest(0, -{c}) ** {k} * greatest(0, -m) ** {k}), 5) as co_lpm from s" for c in "ab" for k in (1, 2)))
def downside_stress(spark, d):
    s = items(spark, d, "l_tax", "l_quantity", "l_discount").select((F.col("l_tax") * 100 - 4).alias("a"), (F.col("l_quantity") - 25).alias("b"), (F.col("l_discount") * 100 - 5).alias("m")).where("m <= -1")
    return rounded(moments.downside_stress(s, ["a", "b"], "m", [1, 2]), 5)


@query()
def arma_auto(spark, d):
    return rounded(grouped.forecast_nonlinear(_monthly(spark, d), "x", "t", ["g"], 4))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracles() -> dict[str, str]:
    return dict(_oracles)
