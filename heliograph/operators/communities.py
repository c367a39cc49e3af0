"""Communities of a weighted graph by the Leiden scheme: local moves, refinement, contraction.

All nodes weigh their moves at once in each round, as joins and aggregates over the edge table. So that neighbours don't change places, a
round lets nodes move only up or only down a random order of communities, in turn. Communities are then refined: their nodes
start alone again and join neighbours inside their community only, and what results is contracted to the nodes of the next level,
which starts from the communities before refinement. A contracted graph of at most ``LAST`` edges goes through the levels that are left in one
task, by the same rounds. At the end a community that isn't connected is split into its components, which
never lowers modularity.

Edges with a null end or a weight that isn't positive count nothing; repeated edges and both directions add up; an edge from a node to itself
counts for the node's weight; no edges give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import connected_components
from .state import written

#: Edges, counted in both directions, of a contracted graph whose further levels one task computes.
LAST = 1_000_000


def kept(df: DataFrame) -> DataFrame:
    return written(df, "communities")


def local_moves(nodes: DataFrame, edges: DataFrame, total: float, resolution: float, rounds: int, inside: bool = False, least: float = 1e-4) -> DataFrame:
    """nodes (node, k, own, within, comm) with the communities that moves by gain of modularity lead to; edges (src, dst, w) in both directions.

    ``own`` is the weight of a node's edges to itself. With ``inside`` only communities in the same ``within`` are considered. A
    round that loses modularity is undone and ends the moves, as do rounds that gain less than ``least``.
    """
    best, best_q, flat = nodes, None, 0
    for r in range(2 * rounds):
        sizes = nodes.groupBy("comm").agg(F.sum("k").alias("all_k"))
        now = nodes.join(sizes, "comm")
        to = edges.join(now.select(F.col("node").alias("dst"), F.col("comm").alias("to"), F.col("all_k").alias("to_k"), F.col("within").alias("to_within")), "dst")
        to = to.groupBy(F.col("src").alias("node"), "to").agg(F.sum("w").alias("w"), F.first("to_k").alias("to_k"), F.first("to_within").alias("to_within"))
        here = F.col("to") == F.col("comm")
        gain = F.col("w") - resolution * F.col("k") * F.col("to_k") / total
        order = lambda c: F.xxhash64(c, F.lit(r // 2))
        allowed = ~here & (order(F.col("to")) < order(F.col("comm")) if r % 2 else order(F.col("to")) > order(F.col("comm")))
        if inside:
            allowed &= F.col("to_within") == F.col("within")
        scored = now.join(to, "node", "left").groupBy("node").agg(
            *(F.first(c).alias(c) for c in ("k", "own", "within", "comm", "all_k")),
            F.max(F.when(allowed, F.struct(gain.alias("gain"), (-F.hash("to")).alias("h"), F.col("to").alias("to")))).alias("go"),
            F.coalesce(F.max(F.when(here, F.col("w"))), F.lit(0.0)).alias("w_in"),
        )
        stay = F.col("w_in") - resolution * F.col("k") * (F.col("all_k") - F.col("k")) / total
        better = F.coalesce(F.col("go.gain") > stay + 1e-12, F.lit(False))
        scored = kept(scored.select("node", "k", "own", "within", "comm", F.when(better, F.col("go.to")).otherwise(F.col("comm")).alias("next"), better.alias("moves"), "w_in"))
        parts = scored.groupBy("comm").agg(F.sum(F.col("w_in") + F.col("own")).alias("w_in"), F.sum("k").alias("all_k"), F.sum(F.col("moves").cast("long")).alias("moves"))
        state = parts.agg(F.sum(F.col("w_in") / total - resolution * (F.col("all_k") / total) ** 2).alias("q"), F.sum("moves").alias("moves")).first()
        q = state["q"] or 0.0
        if best_q is not None and q < best_q + least:
            flat += 1
        else:
            flat = 0
        if best_q is None or q > best_q:
            best, best_q = scored.select("node", "k", "own", "within", "comm"), q
        if flat >= 2 or (not state["moves"] and r % 2):
            break
        nodes = scored.select("node", "k", "own", "within", F.col("next").alias("comm"))
    return best


class Small:
    """A graph in memory: nodes and communities are numbers of labels, edges (src, dst, w) numbers of nodes, and the rounds those of ``local_moves``."""

    def __init__(self, order: np.ndarray, tie: np.ndarray, total: float, resolution: float):
        self.order, self.tie, self.total, self.resolution = order, tie, total, resolution

    def moves(self, nodes: tuple, edges: tuple, rounds: int, within: np.ndarray | None = None, least: float = 1e-4) -> np.ndarray:
        _, k, own, comm = nodes
        src, dst, w = edges
        n, m = len(k), len(self.tie)
        best, best_q, flat = comm, None, 0
        for r in range(2 * rounds):
            ways, at = np.unique(np.concatenate([src * m + comm[dst], np.arange(n) * m + comm]), return_inverse=True)
            node, to = ways // m, ways % m
            weight = np.bincount(at, np.concatenate([w, np.zeros(n)]), len(ways))
            all_k, here = np.bincount(comm, k, m), to == comm[node]
            gain = weight - self.resolution * k[node] * (all_k[to] - np.where(here, k[node], 0)) / self.total
            order = self.order[:, r // 2]
            allowed = here | (order[to] < order[comm[node]] if r % 2 else order[to] > order[comm[node]])
            if within is not None:
                of = np.full(m, -1)
                of[comm] = within
                allowed &= here | (of[to] == within[node])
            tried = np.flatnonzero(allowed)
            tried = tried[np.lexsort((to[tried], self.tie[to[tried]], gain[tried], node[tried]))]
            go = tried[np.append(np.diff(node[tried]) > 0, True)]
            better = gain[go] > gain[here] + 1e-12
            q = ((np.bincount(comm, weight[here] + own, m) / self.total) - self.resolution * (all_k / self.total) ** 2).sum()
            flat = flat + 1 if best_q is not None and q < best_q + least else 0
            if best_q is None or q > best_q:
                best, best_q = comm, q
            if flat >= 2 or (not better.any() and r % 2):
                break
            comm = np.where(better, to[go], comm)
        return best

    def levels(self, nodes: tuple, edges: tuple, rounds: int, levels: int) -> np.ndarray:
        """The community of each node after so many levels."""
        now, out = np.arange(len(nodes[0])), nodes[3]
        for _ in range(levels):
            label, k, own, _ = nodes
            moved = self.moves(nodes, edges, rounds)
            fine = self.moves((label, k, own, label), edges, 2, moved)
            out = moved[now]
            label, to = np.unique(fine, return_inverse=True)
            pairs, at = np.unique(to[edges[0]] * len(label) + to[edges[1]], return_inverse=True)
            a, b, w = pairs // len(label), pairs % len(label), np.bincount(at, edges[2], len(pairs))
            comm = np.empty(len(label), np.int64)
            comm[to] = moved
            own = np.bincount(to, own, len(label)) + np.bincount(a[a == b], w[a == b], len(label))
            before, nodes, edges, now = len(k), (label, np.bincount(to, k, len(label)), own, comm), (a[a != b], b[a != b], w[a != b]), to[now]
            if len(label) == before:
                break
        return out


def last_levels(nodes: DataFrame, edges: DataFrame, total: float, resolution: float, rounds: int, levels: int) -> DataFrame:
    """now (a node) and within (its community) after the levels that are left, all in one task."""
    said = lambda c: (F.array(*(F.xxhash64(c, F.lit(i)) for i in range(max(2, rounds)))), (-F.hash(c)).cast("long"))
    rows = nodes.select("node", "k", "own", "comm", *(x.alias(f"{c}_{name}") for c in ("node", "comm") for name, x in zip(("order", "tie"), said(c), strict=True)), F.lit(0).alias("one"))
    kind = nodes.schema["node"].dataType.simpleString()

    def run(rows: pa.Table, edges: pa.Table) -> pa.Table:
        node, comm = (rows[c].to_numpy() for c in ("node", "comm"))
        labels, first, at = np.unique(np.concatenate([node, comm]), return_index=True, return_inverse=True)
        both = lambda name: np.concatenate([np.stack(rows[f"{c}_{name}"].to_numpy()) for c in ("node", "comm")])[first]
        place = np.argsort(node)
        src, dst = (place[np.searchsorted(node[place], edges[c].to_numpy())] for c in ("src", "dst"))
        small = Small(both("order"), both("tie"), total, resolution)
        found = small.levels((at[: len(node)], rows["k"].to_numpy(), rows["own"].to_numpy(), at[len(node) :]), (src, dst, edges["w"].to_numpy()), rounds, levels)
        return pa.table({"now": rows["node"], "within": pa.array(labels[found], rows["node"].type)})

    return rows.groupBy("one").cogroup(edges.select("*", F.lit(0).alias("one")).groupBy("one")).applyInArrow(run, f"now {kind}, within {kind}")


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 8, levels: int = 8, last: int = LAST) -> DataFrame:
    """edges (src, dst, weight), undirected -> node and community (its smallest node)."""
    clean = edges.where("src IS NOT NULL AND dst IS NOT NULL AND weight > 0").select("src", "dst", F.col("weight").cast("double").alias("w"))
    both = kept(clean.unionByName(clean.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    total = both.agg(F.sum("w")).first()[0]
    if not total:
        return both.select(F.col("src").alias("node"), F.col("src").alias("community")).limit(0)
    own = F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0))
    nodes = kept(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"), own.alias("own")))
    apart = both.where("src <> dst")
    names = nodes.select("node", F.col("node").alias("now"))
    nodes = nodes.withColumn("within", F.lit(None).cast(nodes.schema["node"].dataType)).withColumn("comm", F.col("node"))
    n = nodes.count()
    for level in range(levels):
        if level and apart.count() <= last:
            ended = kept(last_levels(nodes, apart, total, resolution, rounds, levels - level))
            names = names.select("node", "now").join(ended, "now").select("node", "now", "within")
            break
        moved = local_moves(nodes, apart, total, resolution, rounds)
        alone = moved.select("node", "k", "own", F.col("comm").alias("within"), F.col("node").alias("comm"))
        fine = kept(local_moves(alone, apart, total, resolution, 2, inside=True))
        to = fine.select(F.col("node"), F.col("comm").alias("fine"), "within")
        names = kept(names.select("node", "now").join(to.select(F.col("node").alias("now"), F.col("fine"), "within"), "now").select("node", F.col("fine").alias("now"), "within"))
        ends = apart.join(to.select(F.col("node").alias("src"), F.col("fine").alias("a")), "src").join(to.select(F.col("node").alias("dst"), F.col("fine").alias("b")), "dst")
        joined = kept(ends.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        inner = joined.where("src = dst").select(F.col("src").alias("node"), F.col("w").alias("inner"))
        nodes = fine.groupBy(F.col("comm").alias("node")).agg(F.sum("k").alias("k"), F.sum("own").alias("own"), F.first("within").alias("comm"))
        nodes = nodes.join(inner, "node", "left").select("node", "k", (F.col("own") + F.coalesce("inner", F.lit(0.0))).alias("own"), F.lit(None).cast(nodes.schema["node"].dataType).alias("within"), "comm")
        nodes, apart = kept(nodes), joined.where("src <> dst")
        left = nodes.count()
        if left == n:
            break
        n = left
    return connected_parts(names.select("node", F.col("within").alias("comm")), both)


def connected_parts(found: DataFrame, both: DataFrame) -> DataFrame:
    """Communities split into their connected components, named by their smallest node."""
    with_comm = both.join(found.toDF("src", "a"), "src").join(found.toDF("dst", "b"), "dst").where("a = b")
    parts = connected_components(with_comm.where("src < dst").select("src", "dst"))
    return found.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def modularity(edges: DataFrame, found: DataFrame, resolution: float = 1.0) -> DataFrame:
    """community, size, internal and external edges, and its part of the modularity, as a table; edges as given, each once."""
    clean = edges.where("src IS NOT NULL AND dst IS NOT NULL AND weight > 0")
    ends = clean.join(found.toDF("src", "a"), "src").join(found.toDF("dst", "b"), "dst")
    total = clean.agg(F.sum(F.col("weight").cast("double"))).first()[0] or 1.0
    same = F.col("a") == F.col("b")
    sides = ends.select(F.explode(F.when(same, F.array(F.struct(F.col("a").alias("community"), F.lit(1).alias("internal"), F.lit(0).alias("external"), (2.0 * F.col("weight")).alias("k"), F.col("weight").cast("double").alias("w")))).otherwise(
        F.transform(F.array("a", "b"), lambda c: F.struct(c.alias("community"), F.lit(0).alias("internal"), F.lit(1).alias("external"), F.col("weight").cast("double").alias("k"), F.lit(0.0).alias("w"))))).alias("s"))
    sums = sides.select("s.*").groupBy("community").agg(F.sum("internal").alias("internal_edges"), F.sum("external").alias("external_edges"), F.sum("k").alias("k"), F.sum("w").alias("w"))
    sizes = found.groupBy("community").agg(F.count("*").alias("size"))
    return sizes.join(sums, "community").select("community", "size", "internal_edges", "external_edges", (F.col("w") / total - resolution * (F.col("k") / (2 * total)) ** 2).alias("modularity"))
