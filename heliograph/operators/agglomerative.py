"""Ward clustering along a neighbour graph by rounds of reciprocal nearest clusters.

In each round every cluster finds its nearest linked one, and pairs that are nearest to each other merge. For Ward's distance such merges
belong to the hierarchy whatever else is merged first, so that a round makes many of them at once. The distance of merged
clusters follows from sizes and centroids, which is the Lance-Williams update in closed form. Links of merged clusters are
joined; on a complete graph the merges are those of the greedy algorithm. Only links of clusters that have changed are measured again. What
is left when there are few clusters, a number that doesn't grow with the rows, goes through the same rounds in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import written

#: Clusters and links that one task finishes.
CLUSTERS, LINKS = 4_096, 131_072
MERGES = "a long, b long, height double, size long"


def kept(df: DataFrame) -> DataFrame:
    return written(df, "ward")


def finish(t: pa.Table) -> pa.Table:
    """The rounds of ``ward_merges`` over clusters (id, n, c) and links (a, b) in one table."""
    held, links = t.filter(pa.compute.is_valid(t["id"])).sort_by("id"), t.filter(pa.compute.is_valid(t["a"]))
    names, n = np.array(held["id"]), np.array(held["n"]).astype(float)
    c = np.array(held["c"].combine_chunks().flatten()).reshape(len(names), -1)
    a, b = (np.searchsorted(names, np.array(links[x])) for x in "ab")
    d, out = np.full(len(a), np.nan), []
    while len(a):
        new = np.flatnonzero(np.isnan(d))
        for begin in range(0, len(new), 8192):
            some = new[begin : begin + 8192]
            na, nb = n[a[some]], n[b[some]]
            d[some] = np.sqrt(2.0 * na * nb / (na + nb) * ((c[a[some]] - c[b[some]]) ** 2).sum(1))
        place = np.empty(len(a), np.int64)
        place[np.lexsort((b, a, d))] = np.arange(len(a))
        best = np.full(len(names), len(a))
        np.minimum.at(best, a, place)
        np.minimum.at(best, b, place)
        now = np.flatnonzero((best[a] == place) & (best[b] == place))
        one, two = a[now], b[now]
        size = n[one] + n[two]
        out.append((names[one], names[two], d[now], size.astype(np.int64)))
        c[one], n[one] = (n[one][:, None] * c[one] + n[two][:, None] * c[two]) / size[:, None], size
        into, changed = np.arange(len(names)), np.zeros(len(names), bool)
        into[two], changed[one] = one, True
        x, y = into[a], into[b]
        d[changed[x] | changed[y]] = np.nan
        a, b = np.minimum(x, y), np.maximum(x, y)
        left = np.unique(a * len(names) + b, return_index=True)[1]
        left = left[a[left] < b[left]]
        a, b, d = a[left], b[left], d[left]
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[]] * 4
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["a", "b", "height", "size"])


def ward_merges(rows: DataFrame, links: DataFrame, row_id: str = "vec_id", vector: str = "embedding", rounds: int = 1000) -> DataFrame:
    """Merges a and b (the smaller name first, which stays), height (the rise of the sum of squares is height^2 / 2) and size, until nothing linked is left.

    links (u, v) are undirected. Clusters are named by their smallest row.
    """
    v = F.col("c")
    clusters = kept(rows.select(F.col(row_id).cast("long").alias("id"), F.lit(1).cast("long").alias("n"), F.col(vector).cast("array<double>").alias("c")).where("c IS NOT NULL"))
    ends = links.select(F.least("u", "v").cast("long").alias("a"), F.greatest("u", "v").cast("long").alias("b")).where("a < b").distinct()
    known = clusters.select("id")  # a link to a row without a vector is none
    ends = ends.join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi")
    pairs = kept(ends.select("a", "b", F.lit(None).cast("double").alias("d"), F.lit(None).cast("long").alias("size")))
    merges = rows.sparkSession.createDataFrame([], MERGES)
    parts, left = [], clusters.count()
    for _ in range(rounds):
        if left <= CLUSTERS and pairs.limit(LINKS + 1).count() <= LINKS:
            both = clusters.select("id", "n", "c").unionByName(pairs.select("a", "b"), allowMissingColumns=True)
            parts.append(kept(both.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(finish, MERGES)))
            break
        ends = pairs.where("d IS NULL").select("a", "b").join(clusters.select(F.col("id").alias("a"), F.col("n").alias("na"), v.alias("ca")), "a").join(clusters.select(F.col("id").alias("b"), F.col("n").alias("nb"), v.alias("cb")), "b")
        far = F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
        measured = ends.select("a", "b", F.sqrt(2.0 * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * far).alias("d"), (F.col("na") + F.col("nb")).alias("size"))
        pairs = kept(pairs.where("d IS NOT NULL").unionByName(measured))
        sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "a", "b", "d", "size"), F.struct(F.col("b").alias("id"), "a", "b", "d", "size"))).alias("s")).select("s.*")
        best = sides.groupBy("id").agg(F.min(F.struct("d", "a", "b", "size")).alias("m"))
        now = kept(best.groupBy("m").agg(F.count("*").alias("sides")).where("sides = 2").select("m.a", "m.b", F.col("m.d").alias("height"), "m.size"))
        made = now.count()
        if not made:
            break
        parts.append(now)
        left -= made
        moved = now.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("into")), F.struct(F.col("b").alias("id"), F.col("a").alias("into")))).alias("s")).select("s.*")
        to = clusters.join(moved, "id", "left")
        joined = to.where("into IS NOT NULL").groupBy(F.col("into").alias("id")).agg(F.collect_list(F.struct("n", "c")).alias("two"))  # two clusters each
        one, other = F.col("two")[0], F.col("two")[1]
        mean = F.zip_with(one["c"], other["c"], lambda x, y: (one["n"] * x + other["n"] * y) / (one["n"] + other["n"]))
        clusters = kept(to.where("into IS NULL").select("id", "n", "c").unionByName(joined.select("id", (one["n"] + other["n"]).alias("n"), mean.alias("c"))))
        renamed = pairs.join(moved.toDF("a", "ra"), "a", "left").join(moved.toDF("b", "rb"), "b", "left")
        same = F.col("ra").isNull() & F.col("rb").isNull()
        renamed = renamed.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"), F.when(same, F.col("d")).alias("d"), F.when(same, F.col("size")).alias("size"))
        pairs = kept(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d", "size").where("a < b").distinct())
    for p in parts:
        merges = merges.unionByName(p)
    return kept(merges)


def ward_clusters(rows: DataFrame, links: DataFrame, clusters: int | None = None, height: float | None = None, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """node and cluster (its smallest node): the hierarchy cut into ``clusters``, or at a ``height``; parts without links stay apart."""
    merges = ward_merges(rows, links, row_id, vector)
    nodes = rows.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("node"))
    if clusters is not None:
        take = max(0, nodes.count() - clusters)
        # heights rise from merge to merge, so that all but the last merges are whole subtrees; a name goes only once
        last = merges.orderBy(F.desc("height"), F.desc("size"), F.desc("a"), F.desc("b")).limit(max(0, merges.count() - take))
        made = merges.join(last.select("b"), "b", "left_anti")
    else:
        made = merges.where(F.col("height") <= height)
    made = kept(made)
    # every merge points from the larger name to the smaller one, and a name goes only once
    up = kept(nodes.join(made.select(F.col("b").alias("node"), F.col("a").alias("up")), "node", "left").select("node", F.coalesce("up", "node").alias("up")))
    while True:
        far = kept(up.join(up.toDF("up", "far"), "up").select("node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")))
        up = far.select("node", "up")
        if not far.where("moved").take(1):
            return up.select("node", F.col("up").alias("cluster"))
