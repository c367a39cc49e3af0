"""Density-based clusters over a neighbour graph: spanning trees, condensed trees with stability, and connected dense rows.

A minimum spanning tree is grown by Boruvka rounds: each component takes its least edge to another one. Where the graph of near
neighbours leaves it open which edge that is, the index is searched for the nearest row of another component. The tree's edges are then
read in blocks of bounded size by ascending distance, which gives the condensed tree from its leaves to its root; clusters
are chosen where they are more stable than what they are made of.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from .graphs import connected_components
from .neighbours import NeighbourGraph
from .state import written

#: Smaller distances count as this one, so that exact copies have a finite weight.
LEAST = 1e-6
#: How many of the nearest rows a search with core distances looks at.
SEEN = 32
EDGES = "a long, b long, w double, u long, v long"


def kept(df: DataFrame) -> DataFrame:
    return written(df, "density")


def least_edges(edges: DataFrame) -> DataFrame:
    """Of edges between components (a, b, w, u, v) each component's least one: comp, other, w, u, v with u < v."""
    e = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = e.agg(F.min(F.struct("w", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).alias("e"))
    sides = e.select(F.explode(F.array(F.struct(F.col("a").alias("comp"), F.col("b").alias("other"), "e"), F.struct(F.col("b").alias("comp"), F.col("a").alias("other"), "e"))).alias("s")).select("s.*")
    return sides.groupBy("comp").agg(F.min(F.struct("e.w", "e.u", "e.v", "other")).alias("m")).select("comp", "m.*")


def roots(chosen: DataFrame) -> DataFrame:
    """comp and root after joining each component with its chosen other one; pointers are doubled until they rest."""
    back = chosen.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    up = kept(chosen.join(back, "other", "left").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root")))
    while True:
        far = kept(up.join(up.toDF("root", "far"), "root", "left").select("comp", F.coalesce("far", "root").alias("root"), (F.coalesce("far", "root") != F.col("root")).alias("moved")))
        up = far.select("comp", "root")
        if not far.where("moved").take(1):
            return up


def merge(labels: DataFrame, up: DataFrame) -> DataFrame:
    return kept(labels.join(up, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))


def largest(labels: DataFrame):
    return labels.groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").first()["comp"]


def outside(index: NeighbourGraph, labels: DataFrame, core: DataFrame | None, where=None, asked: DataFrame | None = None, **options) -> DataFrame:
    """For each row outside the largest component, or each ``asked`` one (node), its nearest row of another one, with core distances some of the nearest: u, v, d and w, the mutual reachability."""
    row = index.row_id
    marked = index.labelled(labels.toDF(row, "comp"), "comp")
    marked.rows = marked.rows.where("comp IS NOT NULL") if where is None else marked.rows
    some = marked.rows.where((F.col("comp").isNotNull()) & (F.col("comp") != largest(labels))) if asked is None else marked.rows.join(asked.toDF(row), row, "left_semi")
    some = some.select(F.col(row).alias("query_id"), index.vector, "comp")
    found = marked.search(some, 1 if core is None else SEEN, F.col("comp").isNotNull(), apart="comp", **options)
    found = found.select(F.col("query_id").alias("u"), F.col(row).alias("v"), F.greatest(F.lit(LEAST), 1 - F.col("similarity")).alias("d"))
    return reach(found.withColumn("w", F.col("d")), core)


def reach(pairs: DataFrame, core: DataFrame | None) -> DataFrame:
    """Mutual reachability of pairs (u, v, w): never less than the core distance of either end."""
    if core is None:
        return pairs
    both = pairs.join(core.toDF("u", "cu"), "u").join(core.toDF("v", "cv"), "v")
    return both.withColumn("w", F.greatest("w", "cu", "cv")).select(*pairs.columns)


def spanning_tree(index: NeighbourGraph, neighbours: int = 10, least_samples: int = 1, **options) -> DataFrame:
    """The minimum spanning tree (u, v, w) of mutual reachability by cosine distance, as exact as the index finds neighbours.

    The core distance of a row is that to its ``least_samples``-th nearest other row. Boruvka rounds over the known edges: a row's edges to other components
    are known as far as its radius. A row is unsure if it may have an edge shorter than those it knows, and a component takes its least edge only if no unsure row
    has a smaller radius. Where none takes one, only such rows search the index, which adds edges and widens their radius.
    """
    from pyspark.sql.window import Window

    near = index.near_pairs(max(neighbours, least_samples), **options).select("src", "dst", F.greatest("distance", F.lit(LEAST)).alias("w"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("w", "dst"))
    core = kept(near.withColumn("place", place).where(F.col("place") == least_samples).select(F.col("src").alias("node"), "w")) if least_samples > 1 else None
    radius = kept(near.groupBy(F.col("src").alias("node")).agg(F.max("w").alias("r")))
    labels = index.rows.select(F.col(index.row_id).alias("node"), F.col(index.row_id).alias("comp"))
    ends = lambda pairs: pairs.join(labels.toDF("u", "a"), "u").join(labels.toDF("v", "b"), "v").select("a", "b", "w", "u", "v")
    open_ = ends(reach(near.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w"), core))
    taken = []
    while True:
        open_ = kept(open_.where("a <> b"))
        least = kept(least_edges(open_))
        known = open_.groupBy(F.col("u").alias("node")).agg(F.min("w").alias("m"))
        unsure = labels.join(radius, "node", "left").join(known, "node", "left").select("node", "comp", F.coalesce("r", F.lit(0.0)).alias("r"), "m").where("m IS NULL OR m > r")
        chosen = kept(least.join(unsure.groupBy("comp").agg(F.min("r").alias("r")), "comp", "left").where("r IS NULL OR w <= r").drop("r"))
        if not chosen.isEmpty():
            taken.append(chosen.select("u", "v", "w").distinct())
            up = roots(chosen)
            labels = merge(labels, up)
            open_ = open_.join(up.toDF("a", "ra"), "a", "left").join(up.toDF("b", "rb"), "b", "left")
            open_ = open_.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "w", "u", "v")
            continue
        if labels.select("comp").distinct().limit(2).count() < 2:
            break
        asked = unsure.where(F.col("comp") != largest(labels)).join(least.select("comp", "w"), "comp", "left")
        asked = kept(asked.where("w IS NULL OR r < w").select("node"))
        links = kept(outside(index, labels, core, asked=asked, **options))
        if links.isEmpty():
            break
        # what is left unknown lies beyond the farthest one found, if as many were found as looked for
        full = F.when(F.count("*") >= (1 if core is None else SEEN), F.greatest(F.max("d"), F.min("w")))
        wider = asked.join(links.groupBy(F.col("u").alias("node")).agg(full.alias("far")), "node", "left").select("node", F.coalesce("far", F.lit(float("inf"))).alias("far"))
        radius = kept(labels.select("node").join(radius, "node", "left").join(wider, "node", "left").select("node", F.coalesce("far", "r").alias("r")))
        open_ = open_.unionByName(ends(links))
    return kept(reduce(DataFrame.unionByName, taken)) if taken else near.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w").limit(0)


def spanning_forest_once(labels: DataFrame, links: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """One Boruvka round: only components that were asked take their least link."""
    ends = links.join(labels.toDF("u", "a"), "u").join(labels.toDF("v", "b"), "v").select("a", "b", "w", "u", "v")
    chosen = kept(least_edges(ends).where(F.col("comp") != largest(labels)))  # the largest one wasn't asked
    if chosen.isEmpty():
        return None, labels
    return chosen.select("u", "v", "w").distinct(), merge(labels, roots(chosen))


class Block:
    """Reads edges of a spanning tree in ascending order and keeps, for each open component, what the condensed tree needs.

    A component is [size, its cluster or None, sum of the densities at which rows leave the cluster, worth of the clusters below,
    rows while it is smaller than a cluster].
    """

    def __init__(self, block: int, smallest: int):
        self.smallest, self.next = smallest, block << 40
        self.state: dict[int, list] = {}
        self.up: dict[int, int] = {}
        self.members: list[tuple[int, int]] = []
        self.clusters: list[tuple[int, int, float, float]] = []

    def find(self, c: int) -> int:
        top = c
        while self.up.get(top, top) != top:
            top = self.up[top]
        while c != top:
            self.up[c], c = top, self.up.get(c, c)
        return top

    def close(self, c: list, parent: int | None, density: float) -> float:
        """Ends a cluster at the density where it becomes part of its parent; returns what it is worth."""
        stability = c[2] - c[0] * density
        self.clusters.append((c[1], parent, stability, c[3]))
        return max(stability, c[3])

    def add(self, a: int, b: int, w: float) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        x, y = self.state.pop(a), self.state.pop(b)
        density, size = 1 / w, x[0] + y[0]
        if x[1] is not None and y[1] is not None:
            self.next += 1
            worth = self.close(x, self.next, density) + self.close(y, self.next, density)
            new = [size, self.next, size * density, worth, []]
        elif x[1] is None and y[1] is None:
            new = [size, None, 0.0, 0.0, x[4] + y[4]]
            if size >= self.smallest:
                self.next += 1
                self.members += [(r, self.next) for r in new[4]]
                new = [size, self.next, size * density, 0.0, []]
        else:
            big, small = (x, y) if x[1] is not None else (y, x)
            self.members += [(r, big[1]) for r in small[4]]
            new = [size, big[1], big[2] + small[0] * density, big[3], []]
        self.up[b] = a
        self.state[a] = new


STATE = "comp long, size long, cluster long, leaving double, below double, rows array<long>"
OUT = f"old long, {STATE}, member long, of long, closed long, parent long, stability double, worth double"


def condensed_tree(tree: DataFrame, nodes: DataFrame, smallest: int = 2, block_edges: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Members (member, of) and clusters (closed, parent, stability, worth below) of a spanning tree's condensed tree.

    Blocks of about ``block_edges`` edges follow each other by ascending distance, each in one task; between them the components are tables.
    """
    blocks = max(1, -(-tree.count() // block_edges))
    sorted_ = kept(tree.withColumn("h", F.xxhash64("u", "v")).repartitionByRange(blocks, "w", "h").withColumn("block", F.spark_partition_id()))
    labels = nodes.select("node", F.col("node").alias("comp"))
    state = kept(nodes.select(F.col("node").alias("comp"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("cluster"), F.lit(0.0).alias("leaving"), F.lit(0.0).alias("below"), F.array("node").alias("rows")))
    outs = []
    for i in range(blocks):
        ends = sorted_.where(F.col("block") == i).join(labels.toDF("u", "a"), "u").join(labels.toDF("v", "b"), "v")
        of = lambda side: state.select(F.col("comp").alias(side), F.struct("size", "cluster", "leaving", "below", "rows").alias(f"s{side}"))
        read = ends.join(of("a"), "a").join(of("b"), "b").select("w", "h", "a", "b", "sa", "sb", F.lit(0).alias("one"))

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("w", "ascending"), ("h", "ascending"), ("a", "ascending"), ("b", "ascending")])
            now = Block(i, smallest)  # noqa: B023  used within this round
            rows = t.to_pylist()
            for r in rows:
                for c, s in ((r["a"], r["sa"]), (r["b"], r["sb"])):
                    now.state.setdefault(c, list(s.values()))
            for r in rows:
                now.add(r["a"], r["b"], r["w"])
            out = []
            for c in {r[k] for r in rows for k in ("a", "b")}:
                top = now.find(c)
                size, cluster, leaving, below, members = now.state[top]
                held = {"comp": top} if top != c else {"comp": top, "size": size, "cluster": cluster, "leaving": leaving, "below": below, "rows": members}
                out.append({"old": c} | held)
            out += [{"member": m, "of": c} for m, c in now.members]
            out += [{"closed": c, "parent": p, "stability": s, "worth": b} for c, p, s, b in now.clusters]
            return pa.Table.from_pylist(out, schema=ARROW)

        out = kept(read.groupBy("one").applyInArrow(run, OUT))
        outs.append(out)
        if i + 1 < blocks:
            labels = merge(labels, out.where("old IS NOT NULL").select(F.col("old").alias("comp"), F.col("comp").alias("root")))
        changed = out.where("old IS NOT NULL")
        state = kept(state.join(changed.select(F.col("old").alias("comp")), "comp", "left_anti").unionByName(changed.where("size IS NOT NULL").select(*state.columns)))
    found = reduce(DataFrame.unionByName, outs)
    # what is left are whole trees: the root of a single one is no cluster, one of several may be one
    top = state.where("cluster IS NOT NULL")
    several = state.limit(2).count() > 1
    last = top.select(F.col("cluster").alias("closed"), F.lit(None).cast("long").alias("parent"), (F.col("leaving") if several else F.lit(-1.0)).alias("stability"), F.col("below").alias("worth"))
    clusters = found.where("closed IS NOT NULL").select("closed", "parent", "stability", "worth").unionByName(last)
    return found.where("member IS NOT NULL").select("member", "of"), kept(clusters)


ARROW = pa.schema([(name, {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}[kind]) for name, kind in (c.split() for c in OUT.split(", "))])


def chosen_clusters(clusters: DataFrame) -> DataFrame:
    """closed and top, its topmost ancestor (or itself) that is worth as much as the clusters below it; without one it has no row."""
    now = clusters.select("closed", "parent", F.when((F.col("stability") >= F.col("worth")) & (F.col("stability") >= 0), F.col("closed")).alias("top"))
    while True:
        above = now.toDF("parent", "grand", "higher")
        now = kept(now.join(above, "parent", "left").select("closed", F.col("grand").alias("parent"), F.coalesce("higher", "top").alias("top")))
        if not now.where("parent IS NOT NULL").take(1):
            return now.where("top IS NOT NULL").select("closed", "top")


def tree_clusters(index: NeighbourGraph, smallest: int = 2, least_samples: int = 1, neighbours: int = 10, block_edges: int = 2_000_000, **options) -> DataFrame:
    """node and cluster (its smallest node): clusters of most stability in the density tree; noise has no row.

    Fewer rows than ``smallest`` are one cluster.
    """
    nodes = index.rows.select(F.col(index.row_id).cast("long").alias("node"))
    if nodes.limit(smallest).count() < smallest:
        return nodes.select("node", F.col("node").alias("cluster")) if smallest <= 2 else nodes.select("node", F.lit(nodes.agg(F.min("node")).first()[0]).alias("cluster"))
    members, clusters = condensed_tree(spanning_tree(index, neighbours, least_samples, **options), nodes, smallest, block_edges)
    found = members.join(chosen_clusters(clusters).withColumnRenamed("closed", "of"), "of").select(F.col("member").alias("node"), "top")
    return found.join(found.groupBy("top").agg(F.min("node").alias("cluster")), "top").select("node", "cluster")


def dense_clusters(index: NeighbourGraph, eps: float = 0.5, least: int = 5, neighbours: int = 16, **options) -> DataFrame:
    """DBSCAN by cosine distance: node and component (its smallest core row); noise has no row.

    A row with ``least`` rows within ``eps``, itself included, is a core row. Core rows are linked along the neighbour graph; then rows
    that may have more rows within ``eps`` than they know look for the nearest such row of another component until none is within ``eps``. A border row goes to the component of its nearest core row.
    """
    k = max(neighbours, least)
    near = index.near_pairs(k, **options).where(F.col("distance") <= eps)
    core = kept(near.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least).select("node"))
    if core.isEmpty():
        return core.select("node", F.col("node").alias("component"))
    both = near.join(core.toDF("src"), "src").join(core.toDF("dst"), "dst").select("src", "dst")
    loops = core.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    labels = kept(connected_components(both.unionByName(loops)).toDF("node", "comp"))
    # a row with fewer than k others within eps knows them all: only two rows with k may be linked unseen
    full = kept(near.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") >= k).select("node").join(core, "node"))
    while (asked := kept(labels.join(full, "node"))).select("comp").distinct().limit(2).count() > 1:
        links = outside(index, asked, None, where=True, **options).where(F.col("w") <= eps)
        more, labels = spanning_forest_once(labels, kept(links))
        if more is None:
            break
    labels = labels.join(labels.groupBy("comp").agg(F.min("node").alias("component")), "comp").select("node", "component")
    border = near.join(core.toDF("src"), "src", "left_anti").join(labels.toDF("dst", "component"), "dst")
    border = border.groupBy(F.col("src").alias("node")).agg(F.min_by("component", F.struct("distance", "dst")).alias("component"))
    return labels.unionByName(border)


def cluster_figures(rows: DataFrame, found: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """component, size, centroid, density (1 / mean distance to the centroid) and coherence (mean cosine of its pairs), largest first.

    The sum over all pairs is the squared length of the sum of unit vectors, so that no pairs are made.
    """
    v = F.col("v")
    read = rows.select(F.col(row_id).alias("node"), F.col(vector).cast("array<double>").alias("v")).join(found, "node")
    size = F.sqrt(scores.dot(v, v))
    each = read.select("component", "v", F.posexplode(F.arrays_zip(v, F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(0.0)).alias("e"))).alias("d", "x"))
    sums = each.groupBy("component", "d").agg(F.avg("x.v").alias("c"), F.sum("x.e").alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda x: x["c"]).alias("centroid"), F.sum(F.col("s") * F.col("s")).alias("s2"), F.max("n").alias("size"))
    far = read.join(whole.select("component", "centroid"), "component")
    far = far.groupBy("component").agg(F.avg(F.sqrt(F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))).alias("m"))
    n = F.col("size")
    return whole.join(far, "component").select("component", "size", "centroid", (1 / (F.col("m") + 1e-8)).alias("density"), F.when(n > 1, (F.col("s2") - n) / (n * (n - 1))).otherwise(1.0).alias("coherence"))
