"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Defined results: edges with a null end say nothing; an edge from a node to itself links nothing; repeated edges count
once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def apart(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` of many rows with one row a key, though ``right`` may be partitioned by it already.

    A second key, which follows from the first, gives both sides exchanges of their own. Adaptive execution can split
    these at a hot key, and couldn't split the partitions of an aggregate.
    """
    also = F.xxhash64(key).alias("_also")
    return left.select("*", also).join(right.select("*", also), [key, "_also"]).drop("_also")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return apart(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    around = apart(down, least, "u")
    return around.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), u <> v -> node and root, the smallest node of its component, for every node that isn't one itself.

    Each round is written to the shared folder. The rounds grow with the logarithm of the longest path.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = common.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = state(now)
    while seen[0]:
        now = common.cut(small_star(large_star(now)))
        before, seen = seen, state(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
