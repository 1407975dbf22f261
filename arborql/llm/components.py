"""Connected components by alternating large and small stars; all state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("x", "y").unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
    low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    return both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    low = down.groupBy("x").agg(F.min("y").alias("m"))
    moved = down.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.unionByName(low.select("x", F.col("m").alias("y"))).where("x <> y").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (x, y) -> (node, component), the component named by its smallest node; nodes without edges are absent.

    The rounds grow with the logarithm of the longest path. Null ends and loops are
    ignored, repeated edges count once, no edges give no rows.
    """
    e = materialize(edges.select("x", "y").where("x is not null and y is not null and x <> y").distinct(), "edges")
    state = None
    while True:
        old, e = e, materialize(_small_star(_large_star(e)), "stars")
        discard(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(e.select(F.col("y").alias("node"), F.col("y").alias("component"))).distinct()
