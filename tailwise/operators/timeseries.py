"""Series operators that need no model: lags, seasonality, static linear forecasts, rolling signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailwise.functions.expr import col, lpm, safe_ratio, upm


def indexed(df: DataFrame, value: str, order: str, series: list[str] = ()) -> DataFrame:
    """series, i (1, 2, ...), n, x in the order of the series' time."""
    w = Window.partitionBy(*[F.col(s) for s in series])
    return df.select(*series, F.col(order).alias("_o"), col(value).alias("x")).select(*series, F.row_number().over(w.orderBy("_o")).alias("i"), F.count("*").over(w).alias("n"), "x")


def lag_matrix(df: DataFrame, columns: list[str], order: str, tau: int, series: list[str] = ()) -> DataFrame:
    """<column>_tau_k for k = 0 .. tau; rows without all lags go."""
    w = Window.partitionBy(*[F.col(s) for s in series]).orderBy(order)
    out = df.select(*series, order, F.row_number().over(w).alias("_i"), *[F.lag(col(c), k).over(w).alias(f"{c}_tau_{k}") for c in columns for k in range(tau + 1)])
    return out.where(F.col("_i") > tau).drop("_i")


def seasonality(df: DataFrame, value: str, order: str, series: list[str] = ()) -> DataFrame:
    """series, period, cv, baseline: periods whose subsequences, taken backwards from the end, from the last but
    one and from the last but two, all vary no more than the series. A row meets only the periods that divide its
    distance from the end, so rows grow as n log n; its divisors are found up to its root. Series with mean 0 or below 5 values give period 0 and none."""
    rows = indexed(df, value, order, series)
    base = rows.groupBy(*series).agg(F.abs(safe_ratio(F.stddev_samp("x"), F.avg("x"))).alias("baseline"), F.max("n").alias("n"))
    shift = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("s")
    from_end = rows.select(*series, "n", "x", "i", shift).withColumn("d", F.col("n") - F.col("i") - F.col("s")).where("d >= 0")
    most = F.greatest((F.col("n") / 2).cast("long"), F.lit(1).cast("long"))
    small = F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(F.floor(F.sqrt(F.col("d").cast("double"))), F.lit(1))), lambda p: F.col("d") % p == 0)
    divisors = F.filter(F.array_union(small, F.transform(small, lambda p: F.floor(F.col("d") / p))), lambda p: p <= most)
    # Every period divides 0.
    periods = F.when(F.col("d") == 0, F.sequence(F.lit(1).cast("long"), most)).otherwise(divisors)
    parts = from_end.select(*series, "x", "s", F.explode(periods).alias("period"))
    stats = parts.groupBy(*series, "period", "s").agg(F.abs(safe_ratio(F.stddev_samp("x"), F.avg("x"))).alias("c"))
    keyed = base.withColumnsRenamed({c: f"_g_{c}" for c in series})
    stats = stats.join(keyed, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in series]) if series else stats.join(F.broadcast(keyed))
    stats = stats.withColumn("c", F.coalesce("c", "baseline")).where(F.col("n") >= 5)
    # The baseline itself, up to rounding, counts as no more than the baseline.
    kept = stats.groupBy(*series, "period").agg(F.max("c").alias("most"), F.avg("c").alias("cv"), F.first("baseline").alias("baseline"), F.first("n").alias("n"))
    return kept.where("most <= baseline * (1 + 1e-12) and period < n / 2.0").select(*series, "period", "cv", "baseline")


def linear_static(df: DataFrame, value: str, order: str, lag: int, h: int, series: list[str] = (), negative: bool = False) -> DataFrame:
    """series, step (1 .. h), forecast: a least-squares line through each residue class of the lag, carried on.
    One aggregation whatever the length of the series."""
    rows = indexed(df, value, order, series).withColumn("k", F.col("i") - F.col("n") - 1)
    rows = rows.withColumn("c", F.pmod("k", F.lit(lag)))  # step s continues the class of (s - 1) mod lag
    m = F.floor(F.col("k") / lag)  # ..., -2, -1 within the class; the forecasts are 0, 1, ...
    fit = rows.groupBy(*series, "c").agg(F.regr_slope(F.col("x"), m.cast("double")).alias("b"), F.avg("x").alias("mx"), F.avg(m.cast("double")).alias("mm"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")
    out = fit.select("*", steps).where(F.pmod(F.col("step") - 1, F.lit(lag)) == F.col("c"))
    slope = F.coalesce(F.col("b"), F.lit(0.0))
    value = F.col("mx") + slope * (F.floor((F.col("step") - 1) / lag) - F.col("mm"))
    return out.select(*series, "step", (value if negative else F.greatest(value, F.lit(0.0))).alias("forecast"))


def rolling_dispersion(df: DataFrame, value: str, day: str, market: str, window: int) -> DataFrame:
    """day, ratio = sqrt(U2) / sqrt(L2) of the day's values against the day's market column, and its mean over the
    last window days. Days are few beside rows, so one window over them is a small sort."""
    per_day = df.groupBy(day).agg(safe_ratio(F.sqrt(upm(value, F.col(market), 2)), F.sqrt(lpm(value, F.col(market), 2))).alias("ratio"))
    return per_day.select(day, "ratio", F.avg("ratio").over(Window.orderBy(day).rowsBetween(1 - window, 0)).alias("signal"))
