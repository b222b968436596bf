"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailwise.llm.common import staged


def _pointed(edges: DataFrame, both: bool) -> DataFrame:
    """One star step over edges (u > v). Hubs are minima first and joins after, so no node's edges meet in a list."""
    if both:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return sides.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long, not null) to (node, component): the least node reachable. Only nodes of edges appear.
    The number of rounds grows with the logarithm of the longest path; each round is written to the shared folder."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = staged(now, "edges"), None
    while True:
        now = staged(_pointed(_pointed(now, True).where("u <> v").distinct(), False).where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
