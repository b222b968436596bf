"""Factor codes, dummies and class balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def factor_code(value: Column | str, levels: list) -> Column:
    """1-based place among the levels as a double; NULL for others."""
    value = F.col(value) if isinstance(value, str) else value
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), value)
    return F.when(place > 0, place.cast("double"))


def dummies(df: DataFrame, column: str, levels: list, full: bool = False) -> DataFrame:
    """df with a 0/1 column per level, without the first unless full."""
    return df.withColumns({f"{column}_{x}": F.when(F.col(column) == x, 1.0).otherwise(0.0) for x in (levels if full else levels[1:])})


def down_sample(df: DataFrame, column: str, seed: int = 0, keys: list[str] = ()) -> DataFrame:
    """As many rows of each class as the smallest has, chosen by a hash of keys (all columns if none)."""
    counts = df.groupBy(column).count()
    least = counts.agg(F.min("count")).first()[0] or 0
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in (keys or df.columns)])
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(column).orderBy(h, *(keys or df.columns))))
    return ranked.where(F.col("_r") <= least).drop("_r")


def up_sample(df: DataFrame, column: str, seed: int = 0, keys: list[str] = ()) -> DataFrame:
    """As many rows of each class as the largest has: a class's rows all stay, and as many as are missing come again, each
    as often as any other or once more, those with the least hash of keys (all columns if none) first."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    sizes = counts.withColumn("_most", F.lit((counts.agg(F.max("_n")).first()[0]) or 0)).withColumnRenamed(column, "_c")
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in (keys or df.columns)])
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(column).orderBy(h, *(keys or df.columns))) - 1)
    times = F.floor(F.col("_most") / F.col("_n")) + F.when(F.col("_r") < F.col("_most") % F.col("_n"), 1).otherwise(0)
    out = ranked.join(F.broadcast(sizes), F.col(column).eqNullSafe(F.col("_c"))).withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return out.drop("_r", "_n", "_most", "_c", "_t")
