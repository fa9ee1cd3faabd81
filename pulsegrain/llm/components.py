"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, written


#: Edges that a task writes at least.
EDGES = 50_000


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Node, and the smallest node of its component as `root`, for all nodes of `edges`.

    Each step aggregates neighbours to their minimum before joining, so a hub costs its edges and no pairs; the minima are a
    table of their own, which is broadcast while it is small, and beyond that lets the join split a hub's edges.
    Steps are logarithmic in number; each is a table in the folder of checkpoints. (A checkpoint would carry on the planner's
    estimate of its size, which joins multiply, until its digits take longer than all else.) An empty edge list gives no rows; loops and repeats are harmless.
    """
    nodes = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now = written(nodes.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = _digest(now)
    while before[0]:
        # no more minima than twice the edges
        side = F.broadcast if before[0] * 64 <= BROADCAST_BYTES else written
        # few edges are few files; many stay in the partitions they have
        few = max(8, before[0] // EDGES)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = side(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large.coalesce(few))
        low = side(large.groupBy("u").agg(F.min("v").alias("m")))
        pairs = large.join(low, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small.coalesce(few))
        after = _digest(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("u")).distinct().withColumn("root", F.col("u"))
    found = now.select("u", F.col("v").alias("root")).unionByName(roots).groupBy("u").agg(F.min("root").alias("root"))
    alone = nodes.where("u = v").select("u").distinct().withColumn("root", F.col("u"))
    return found.unionByName(alone).groupBy("u").agg(F.min("root").alias("root")).withColumnRenamed("u", "node")
