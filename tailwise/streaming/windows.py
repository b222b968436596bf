"""Partial moments of event-time windows: with a fixed target they are sums, so they update incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailwise.functions.expr import lpm, upm


def windowed_moments(events: DataFrame, time: str, value: str, target: float, width: str, slide: str | None = None, late: str | None = None, keys: list[str] = ()) -> DataFrame:
    """start, end, keys, n, lpm1, upm1, lpm2, upm2; for a batch or, with late (the watermark), a stream."""
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    if late and df.isStreaming:
        df = df.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = df.groupBy(w.alias("w"), *keys).agg(F.count(value).alias("n"), *[f(value, target, d).alias(f"{name}{d}") for d in (1, 2) for name, f in (("lpm", lpm), ("upm", upm))])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "lpm1", "upm1", "lpm2", "upm2")
