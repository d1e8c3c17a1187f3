"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.store import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b); ``comp`` is the smallest node reachable.

    Every round hangs neighbours under their smallest one; minima are summed before the shuffle, so a node with very many neighbours is
    only met in joins, which Spark splits. The rounds grow with the logarithm of the longest chain; each is written, so lineage stays short.
    They end when every node hangs under one other and none of those hangs under a third.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(now.join(least, "u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(below.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        new = written(small, "stars")
        forget(now)
        now = new
        # of each node: how often it hangs, and whether another hangs under it
        roles = now.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        if roles.groupBy("x").agg(F.sum("hangs").alias("h"), F.max("holds").alias("o")).where("h > 1 or (h = 1 and o = 1)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
