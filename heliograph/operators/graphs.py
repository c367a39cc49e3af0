"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .state import cut

#: Rounds of a search that are kept as tables of their own.
ROUNDS = 8


def bfs_distances(edges: DataFrame, starts: DataFrame, most: int = 1_000_000) -> DataFrame:
    """node and dist, the least number of edges from any start (column node).

    The edges are computed once. Each round is a join of the frontier only and writes what is new; rounds are written
    together again when there are ``ROUNDS`` of them.
    """
    edges = cut(edges.select("src", "dst"))
    frontier = cut(starts.select("node").distinct().withColumn("dist", F.lit(0).cast("long")))
    parts, depth = [frontier], 0
    while depth < most:
        depth += 1
        reached = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, parts)
        frontier = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("dist", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            break
        parts = [*parts, frontier] if len(parts) < ROUNDS else [cut(seen), frontier]
    return reduce(DataFrame.unionByName, parts)


def shortest_path(edges: DataFrame, source, target, most: int = 1_000_000) -> list | None:
    """Nodes of a shortest path, [source] if both are the same, None if there is none. Of equals the smallest parent counts."""
    if source == target:
        return [source]
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    seen = spark.createDataFrame([(source, None, 0)], f"node {kind}, parent {kind}, dist long")
    frontier = seen
    for depth in range(1, most + 1):
        reached = frontier.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent"))
        new = cut(reached.select(F.col("dst").alias("node"), "parent", F.lit(depth).cast("long").alias("dist")).join(seen.select("node"), "node", "left_anti"))
        if new.isEmpty():
            return None
        seen, frontier = cut(seen.unionByName(new)), new
        if new.where(F.col("node") == F.lit(target)).count():
            break
    path, at = [target], target
    while at != source:  # one row for each step of the path
        at = seen.where(F.col("node") == F.lit(at)).select("parent").first()[0]
        path.append(at)
    return path[::-1]


def crawl(edges: DataFrame, starts: DataFrame, depth: int = 3, children: int = 50, least_priority: float = 0.5) -> DataFrame:
    """Bounded breadth-first crawl over edges (src, dst, priority): node, depth. Each node passes on its best ``children``; a node keeps its first depth."""
    kept = edges.where(F.col("priority") >= least_priority)
    w = Window.partitionBy("src").orderBy(F.desc("priority"), "dst")
    kept = kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= children).select("src", "dst")
    return bfs_distances(kept, starts, depth).select("node", F.col("dist").alias("depth"))


def without_node(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes."""
    gone = nodes.select("node")
    return edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns)


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Join of many edges with one row a node. The second key, which follows from the first, gives both sides exchanges of their own, which adaptive execution can split at a hub."""
    also = F.xxhash64("src").alias("_also")
    return edges.select("*", also).join(least.select("*", also), ["src", "_also"]).drop("_also")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) by alternating large and small stars; edges are undirected."""

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        return with_least(both.where("dst > src"), least).select(F.col("dst").alias("src"), F.col("m").alias("dst"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("m"))
        across = with_least(down, least).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        return across.unionByName(least.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()

    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    now = cut(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct())
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    seen = sign(now)
    while seen[0]:
        now = cut(small(large(now)))
        before, seen = seen, sign(now)
        if seen == before:
            break
    return nodes.join(now.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
