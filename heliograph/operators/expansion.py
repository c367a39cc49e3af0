"""Neighbour expansion by a callback: a registered table function that a crawl calls for each node it reaches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from .state import written


def register(spark: SparkSession, name: str, expand: Callable[[object, object], Iterable[tuple]], kind: str = "long") -> None:
    """Make ``expand(node, payload)``, which gives (neighbour, priority) pairs, a table function for SQL's LATERAL."""

    class Expand:
        def eval(self, node, payload):
            for other, priority in expand(node, payload) or ():
                yield other, float(priority)

    spark.udtf.register(name, udtf(Expand, returnType=f"dst: {kind}, priority: double"))


def crawl(nodes: DataFrame, starts: DataFrame, name: str, depth: int = 3, children: int = 50, least_priority: float = 0.5, most_nodes: int | None = None) -> DataFrame:
    """node and depth: breadth-first from starts (column node) over what the table function ``name`` finds for nodes (node, payload).

    Only nodes that a round has reached are expanded; each passes on its best ``children``. ``most_nodes`` ends the crawl after the round that reaches so many.
    """
    spark = nodes.sparkSession
    seen = written(starts.select("node").distinct().withColumn("depth", F.lit(0).cast("long")), "crawl")
    frontier, n = seen, seen.count()
    best = Window.partitionBy("node").orderBy(F.desc("priority"), "dst")
    for step in range(1, depth + 1):
        reached = nodes.join(frontier.select("node"), "node", "left_semi")
        found = spark.sql(f"SELECT n.node, x.dst, x.priority FROM {{reached}} n, LATERAL {name}(n.node, n.payload) x", reached=reached)
        kept = found.where(F.col("priority") >= least_priority).distinct().withColumn("place", F.row_number().over(best)).where(F.col("place") <= children)
        new = kept.select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = written(new.withColumn("depth", F.lit(step).cast("long")), "crawl")
        more = frontier.count()
        seen, n = seen.unionByName(frontier), n + more
        if not more or (most_nodes is not None and n >= most_nodes):
            break
    return seen
