"""A navigable neighbour graph over vectors, kept as Parquet: approximate nearest neighbours by cosine.

Rows are dealt to the cells of a coarse clustering, and a cell with many rows into parts of bounded size. Each part gets a graph of
its own: every row is linked with its nearest rows of the part, thinned so that links point in different directions, and back. A search
walks the graphs of the parts of the nearest cells greedily, a beam of best rows for many queries at once, and merges what
the parts found. An index without links has no graphs: all rows of those parts are looked at, which is cheaper where every row is a
query, since links cost as much to make. A predicate on stored columns is applied before ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from ..functions import scores
from .state import cut

#: Queries that walk a graph together, rows they start from, rows each looks behind at a time; one row in so many is an anchor.
TOGETHER, ENTRIES, WIDTH, ANCHOR = 256, 24, 4, 32
#: Columns in a group when the best of many are sought.
GROUP = 32
GRAPH = "_cell int, _part int, _at int, _links array<int>"


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(flat.flatten(), np.float32).reshape(len(flat), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def anchors(n: int) -> np.ndarray:
    """Positions that every search compares with first; each row is linked with the nearest of them."""
    return np.sort(np.random.default_rng(n).permutation(n)[: max(min(n, ENTRIES), n // ANCHOR)])


def best(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each row, largest first. They lie in the k groups of columns with the largest maxima, and only these are compared."""
    groups = s.shape[1] // GROUP
    if k > groups // 4:
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    else:
        top = np.argpartition(-s[:, : GROUP * groups].reshape(len(s), GROUP, groups).max(axis=1), k - 1, axis=1)[:, :k]
        at = (top[:, :, None] + np.arange(GROUP) * groups).reshape(len(s), -1)
        at = np.concatenate([at, np.broadcast_to(np.arange(GROUP * groups, s.shape[1]), (len(s), s.shape[1] - GROUP * groups))], 1)
        at = np.take_along_axis(at, np.argpartition(-np.take_along_axis(s, at, 1), k - 1, axis=1)[:, :k], 1)
    at.sort(axis=1)
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)


def linked(v: np.ndarray, links: int) -> list[np.ndarray]:
    """For each vector the vectors it is linked with: its two nearest anchors, the nearest ones that aren't nearer to one taken already, and some that chose it."""
    n, most = len(v), min(len(v) - 1, 2 * links)
    chosen: list[list[int]] = [[] for _ in range(n)]
    first = anchors(n)
    for begin in range(0, n, TOGETHER):
        s = v[begin : begin + TOGETHER] @ v.T
        to = first[best(s[:, first], min(2, len(first)))]
        s[np.arange(len(s)), begin + np.arange(len(s))] = -np.inf
        near = best(s, most) if most else np.zeros((len(s), 0), int)
        between = v[near] @ v[near].transpose(0, 2, 1)
        own = np.take_along_axis(s, near, 1)
        taken = np.zeros(near.shape, bool)
        for j in range(near.shape[1]):  # j is taken unless it is nearer to a taken one than to the row
            taken[:, j] = ~(taken[:, :j] & (between[:, j, :j] > own[:, j, None])).any(1) & (taken[:, :j].sum(1) < links)
        taken[:, : min(4, most)] = True
        for i, (ids, t) in enumerate(zip(near, taken, strict=True)):
            chosen[begin + i] = ids[t].tolist() + to[i].tolist()
    back: list[list[int]] = [[] for _ in range(n)]
    for i, ids in enumerate(chosen):
        for j in ids:
            back[j].append(i)
    spread = lambda b: b[:: -(-len(b) // (4 * links))] if b else b
    return [np.array(sorted({*a, *spread(b)} - {i}), np.int32) for i, (a, b) in enumerate(zip(chosen, back, strict=True))]


def walk(v: np.ndarray, links: list, q: np.ndarray, allowed: np.ndarray, k: int, beam: int, groups: np.ndarray | None = None, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and similarities of about the k best allowed rows for each query, -1 where there are fewer.

    With ``groups`` of the rows a query finds only rows of other groups than its own, ``apart``, and walks along these only.
    """
    n = len(v)
    k = min(k, n)
    width = max(map(len, links), default=0)
    if not width or n <= 4 * beam or allowed.sum() < n // 8:  # no graph, or few rows that count: look at all of them
        at, out, sims = np.flatnonzero(allowed), [], []
        some, of = v[at], groups[at] if groups is not None else None
        for begin in range(0, len(q) if len(at) else 0, TOGETHER):
            s = q[begin : begin + TOGETHER] @ some.T
            if groups is not None:
                s[of[None, :] == apart[begin : begin + TOGETHER, None]] = -np.inf
            top = best(s, min(k, len(at)))
            sims.append(np.take_along_axis(s, top, 1))
            out.append(np.where(np.isfinite(sims[-1]), at[top], -1))
        return (np.concatenate(out), np.concatenate(sims)) if out else (np.full((len(q), 0), -1), np.zeros((len(q), 0)))
    table = np.full((n + 1, width), n, np.int32)
    for i, ids in enumerate(links):
        table[i, : len(ids)] = ids
    v = np.concatenate([v, np.zeros((1, v.shape[1]), v.dtype)])
    out, sims, first = [], [], anchors(n)
    for begin in range(0, len(q), TOGETHER):
        some = q[begin : begin + TOGETHER]
        rows = np.arange(len(some))[:, None]
        seen = np.zeros((len(some), n + 1), bool)
        if groups is not None:
            seen[:, :n] = groups[None, :] == apart[begin : begin + TOGETHER, None]
        s = np.where(seen[:, first], -np.inf, some @ v[first].T)
        top = np.argsort(-s, axis=1, kind="stable")[:, :ENTRIES]
        ids, s = first[top], np.take_along_axis(s, top, 1)
        seen[:, n], seen[rows, ids] = True, True
        done = ~np.isfinite(s)
        found, found_s = ids, np.where(allowed[ids], s, -np.inf)
        while True:
            order = np.argsort(-np.where(done, -np.inf, s), axis=1, kind="stable")[:, :WIDTH]
            ahead = ~np.take_along_axis(done, order, 1)
            if not ahead.any():
                break
            np.put_along_axis(done, order, True, 1)
            new = np.where(ahead[:, :, None], table[np.take_along_axis(ids, order, 1)], n).reshape(len(some), -1)
            new = np.where(seen[rows, new], n, new)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            seen[rows, new] = True
            wide = int((new < n).sum(1).max(initial=0))
            if wide:
                new = np.sort(new, axis=1)[:, :wide]
                near = np.where(new < n, np.einsum("qmd,qd->qm", v[new], some), -np.inf)
                ok = np.where((new < n) & np.append(allowed, False)[new], near, -np.inf)
                found, found_s = np.concatenate([found, new], 1), np.concatenate([found_s, ok], 1)
                if found.shape[1] > k:
                    top = np.argpartition(-found_s, k - 1, axis=1)[:, :k]
                    found, found_s = np.take_along_axis(found, top, 1), np.take_along_axis(found_s, top, 1)
                ids, s, done = np.concatenate([ids, new], 1), np.concatenate([s, near], 1), np.concatenate([done, new == n], 1)
                if ids.shape[1] > beam:
                    top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
                    ids, s, done = (np.take_along_axis(x, top, 1) for x in (ids, s, done))
        out.append(np.where(np.isfinite(found_s), found, -1))
        sims.append(found_s)
    most = max((o.shape[1] for o in out), default=0)
    pad = lambda xs, fill: np.concatenate([np.pad(x, ((0, 0), (0, most - x.shape[1])), constant_values=fill) for x in xs]) if xs else np.zeros((0, 0))
    return pad(out, -1), pad(sims, -np.inf)


class NeighbourGraph:
    """``rows``: every row with its vector, cell, part and links; ``cells``: the centroids of the coarse clustering, at most ``lists`` of them."""

    def __init__(self, rows: DataFrame, cells: list[list[float]], row_id: str, vector: str):
        self.rows, self.cells, self.row_id, self.vector = rows, cells, row_id, vector

    @classmethod
    def build(cls, rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = (), links: int = 16, part_rows: int = 65_536, lists: int = 256, sample_rows: int = 50_000, seed: int = 42) -> NeighbourGraph:
        """Index every row. Cells are fitted on about ``sample_rows`` rows; one task builds the graph of one part, about ``part_rows`` rows; with no ``links`` there are no graphs. Null vectors have no place."""
        read = rows.select(row_id, vector, *keep).where(F.col(vector).isNotNull())
        n = read.count()
        k = min(lists, -(-n // part_rows))
        cells = cls.centroids(read.select(vector), k, min(1.0, sample_rows / max(1, n)), seed, vector) if k > 1 else []
        dealt = read.withColumn("_cell", cls.nearest(cells, F.col(vector), 1)[0] if cells else F.lit(0))
        sizes = {r["_cell"]: r["n"] for r in dealt.groupBy("_cell").agg(F.count("*").alias("n")).collect()}  # ``lists`` rows at most
        parts = F.create_map(*(F.lit(x) for c, s in sizes.items() for x in (c, -(-s // part_rows)))) if sizes else F.create_map(F.lit(0), F.lit(1))
        dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(row_id), parts[F.col("_cell")]).cast("int"))

        def graph(t: pa.Table) -> pa.Table:
            t = t.sort_by(row_id)
            for name, column in (("_at", pa.array(np.arange(len(t)), pa.int32())), ("_links", pa.array(linked(unit(t[vector]), links) if links else [[]] * len(t), pa.list_(pa.int32())))):
                t = t.append_column(name, column)
            return t

        schema = StructType([*dealt.schema.fields, *StructType.fromDDL("_at int, _links array<int>").fields])
        return cls(dealt.groupBy("_cell", "_part").applyInArrow(graph, schema), cells, row_id, vector)

    @staticmethod
    def centroids(vectors: DataFrame, k: int, share: float, seed: int, vector: str) -> list[list[float]]:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        v = F.col(vector).cast("array<double>")
        size = F.sqrt(scores.dot(v, v))
        sample = vectors.sample(share, seed).select(array_to_vector(F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)).alias("features"))
        return [list(map(float, c)) for c in KMeans(k=k, seed=seed, maxIter=10).fit(sample).clusterCenters()]

    @staticmethod
    def nearest(cells: list[list[float]], v: Column, probes: int) -> Column:
        """The numbers of the ``probes`` nearest cells, by distance of the unit vector."""
        v = v.cast("array<double>")
        size = F.greatest(F.sqrt(scores.dot(v, v)), F.lit(1e-300))
        each = F.array(*(F.struct((F.lit(sum(x * x for x in c)) - 2 * scores.dot(v, F.array(*map(F.lit, c))) / size).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(cells)))
        return F.transform(F.slice(F.array_sort(each), 1, probes), lambda e: e["cell"])

    def save(self, path: str) -> NeighbourGraph:
        """Write the index into a folder and return it as loaded from there."""
        spark = self.rows.sparkSession
        self.rows.write.option("compression", "zstd").parquet(f"{path}/rows")
        head = spark.createDataFrame([(i, c, self.row_id, self.vector) for i, c in enumerate(self.cells or [[]])], "cell int, centroid array<double>, row_id string, vector string")
        head.coalesce(1).write.parquet(f"{path}/cells")
        return NeighbourGraph.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourGraph:
        head = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        return cls(spark.read.parquet(f"{path}/rows"), [list(r["centroid"]) for r in head if r["centroid"]], head[0]["row_id"], head[0]["vector"])

    def search(self, queries: DataFrame, k: int, where: Column | None = None, query_id: str = "query_id", vector: str | None = None, probes: int = 8, beam: int = 96, block: int = 10_000, apart: str | None = None) -> DataFrame:
        """query_id, row id, similarity and rank of about the k nearest rows that ``where``, a condition on stored columns, allows.

        With ``apart``, a column of the rows and of the queries, only rows with another value of it are found. A part is met by blocks of about ``block`` queries, each in one task.
        """
        row_id, own = self.row_id, self.vector
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector or own).alias("_q"), (F.col(apart) if apart else F.lit(0)).alias("_own")).where("_q IS NOT NULL")
        cells = self.nearest(self.cells, F.col("_q"), probes) if self.cells else F.array(F.lit(0))
        asked = asked.select("query_id", "_q", "_own", F.explode(cells).alias("_cell"))
        counts = self.rows.groupBy("_cell", "_part").agg(F.count("*").alias("n")).select("_cell", "_part")
        blocks = asked.groupBy("_cell").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
        places = counts.join(blocks, "_cell")
        met = asked.join(places, "_cell").select("query_id", "_q", "_own", "_cell", "_part", F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int").alias("_block"))
        held = self.rows.select(row_id, own, "_cell", "_part", "_at", "_links", (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)).alias("_allowed"), (F.col(apart) if apart else F.lit(0)).alias("_group"))
        held = held.join(places, ["_cell", "_part"]).select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")).drop("_blocks")
        kinds = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField(row_id, self.rows.schema[row_id].dataType), *StructType.fromDDL("similarity double").fields])

        def near(rows: pa.Table, some: pa.Table) -> pa.Table:
            if not len(rows) or not len(some):
                return pa.table({"query_id": some["query_id"][:0], row_id: rows[row_id][:0], "similarity": pa.array([], pa.float64())})
            rows = rows.sort_by("_at")
            at, s = walk(unit(rows[own]), rows["_links"].combine_chunks().to_numpy(zero_copy_only=False), unit(some["_q"]), np.array(rows["_allowed"], bool), k, max(beam, 2 * k), *((np.array(rows["_group"]), np.array(some["_own"])) if apart else ()))
            there = at >= 0
            which = np.repeat(np.arange(len(some)), there.sum(1))
            return pa.table({"query_id": some["query_id"].combine_chunks().take(pa.array(which)), row_id: rows[row_id].combine_chunks().take(pa.array(at[there])), "similarity": pa.array(s[there].astype(float))})

        met = met.select("query_id", "_q", "_own", *(F.col(c).alias(c) for c in ("_cell", "_part", "_block")))  # other columns than those of the rows
        found = held.groupBy("_cell", "_part", "_block").cogroup(met.groupBy("_cell", "_part", "_block")).applyInArrow(near, kinds)
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), row_id)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def labelled(self, labels: DataFrame, name: str) -> NeighbourGraph:
        """The index with one more stored column, from a table of row id and value; rows without a value have none."""
        return NeighbourGraph(self.rows.join(labels, self.row_id, "left").select(*self.rows.columns, name), self.cells, self.row_id, self.vector)

    def near_pairs(self, k: int, **options) -> DataFrame:
        """src, dst and distance (1 - cosine): each row with about its k nearest others."""
        rows = self.rows.select(F.col(self.row_id).alias("query_id"), self.vector)
        found = self.search(rows, k + 1, **options).where(F.col("query_id") != F.col(self.row_id)).where(F.col("rank") <= k + 1)
        return cut(found.select(F.col("query_id").alias("src"), F.col(self.row_id).alias("dst"), F.greatest(F.lit(0.0), 1 - F.col("similarity")).alias("distance")))
