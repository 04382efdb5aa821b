"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions.reliability import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, where root is the smallest node reachable.

    Every round links each node's larger neighbours, then its smaller ones, to the
    smallest neighbour known, until nothing changes; chains halve from round to round.
    The minimum per node is aggregated before its shuffle, and the join of a node with
    very many edges can be split, as the minima are one row per node. Only a count of
    changes goes to the driver. Nulls have no edges; loops and repeated edges do no harm.
    """
    found = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    found, before = checkpointed(found), None
    while True:
        both = found.union(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        found = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        state = found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = found.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
