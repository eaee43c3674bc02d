"""Connected components by alternating large-star and small-star steps.

Each step is a groupBy with partial aggregation and a join; nothing is gathered
on the driver but two numbers that tell whether the edges still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ids of edges (a, b long): component is the smallest id reachable."""
    e = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    state = None
    while True:
        e = checkpointed(_small_star(_large_star(e)))
        now = tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == state:
            break
        state = now
    roots = e.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
