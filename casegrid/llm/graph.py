"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import discard, staged


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for every
    node that has one.  Large-star and small-star rounds; each round is written
    to the shared folder and stops when it changes nothing."""
    now = staged(edges.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b"))
                 .where("a < b").distinct(), "edges")
    mark = None
    while True:
        # Large star: a node's larger neighbours go to its smallest one.  What
        # a node has least is written first: a star's centre has most of the
        # edges, and only a join by itself can be split by Spark.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        big = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest.
        small = big.groupBy("b").agg(F.min("a").alias("m"))
        joined = big.join(small, "b").select(
            F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y")
        before, now = now, staged(joined.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        discard(before)
        discard(least)
        stat = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stat == mark:
            break
        mark = stat
    roots = now.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("component")))
