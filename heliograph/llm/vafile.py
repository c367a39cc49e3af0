"""Centroid clustering over a VA-file: exact k-means on integer vectors that reads full vectors only where it has to.

Every vector is kept twice in the shared folder, as it is and as one cell number of few bits per dimension, both bucketed by
row. Lookup tables give, for each dimension, cell and centroid, the least and the greatest distance to the
centroid less the distance to a reference point that all centroids share; their sums are intervals of a vector's distances. Where
one interval lies below all others the cell numbers alone give the nearest centroid. A round of k-means changes the sums of
clusters only by vectors that moved, so that it reads the cells, looks them up with the centroids before and after, and
fetches those vectors whose intervals overlap or whose cluster changed: by a merge join of the bucketed tables, which shuffles
their row numbers only. The sums are exact integers and nothing is kept between rounds but the centroids.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out. Integers are
held to +-2^27, so that squared distances fit a long. Repeated rows and ids count as often as they occur. With
fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 2**27
SUMS = "cluster int, n long, dim int, total decimal(38,0)"
#: Vectors looked up at once.
ROWS = 4096


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dims)


def cells_of(q: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(b, q[:, d], "right") for d, b in enumerate(bounds)], 1).astype(np.uint8)


class Lookup:
    """Distance intervals of cells to centroids, and exact distances where intervals overlap."""

    def __init__(self, centroids: list[list[int]], bounds: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.centroids = c = np.array(centroids, np.int64)
        middle = np.round(c.mean(0)).astype(np.int64)
        ends = [np.concatenate([low[:, None], bounds], 1), np.concatenate([bounds - 1, high[:, None]], 1)]
        # (x - c)^2 - (x - m)^2 is linear in x, so that its extremes are at the cell's ends
        at = [(e[:, :, None] - c.T[:, None, :]) ** 2 - (e[:, :, None] - middle[:, None, None]) ** 2 for e in ends]
        self.table = np.concatenate([np.minimum(*at), np.maximum(*at)], 2)  # dimension, cell, least and greatest of each centroid

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Which centroids may be nearest to each vector."""
        k, out = len(self.centroids), []
        for i in range(0, len(cells), ROWS):
            part = cells[i : i + ROWS]
            total = np.zeros((len(part), 2 * k), np.int64)
            for d, table in enumerate(self.table):
                total += table[part[:, d]]
            out.append(total[:, :k] <= total[:, k:].min(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, k), bool)

    def nearest(self, q: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid, of equals the first, and its squared distance; only candidates are measured."""
        best = np.full(len(q), np.iinfo(np.int64).max)
        cluster = np.zeros(len(q), np.int64)
        for c, centroid in enumerate(self.centroids):
            at = np.flatnonzero(may[:, c])
            distance = ((q[at] - centroid) ** 2).sum(1)
            less = distance < best[at]
            best[at[less]], cluster[at[less]] = distance[less], c
        return cluster, best


def sums(cluster: np.ndarray, q: np.ndarray, sign: np.ndarray, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    np.add.at(n, cluster, sign)
    for c in np.unique(cluster):
        at = cluster == c
        total[c] = (q[at] * sign[at][:, None]).sum(0)
    return n, total


def sum_rows(n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    """One row for each cluster and dimension."""
    k, dims = total.shape
    exact = [int(x) for x in total.ravel()]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dims), pa.int32()), pa.array(np.repeat(n, dims), pa.int64()), pa.array(np.tile(np.arange(dims), k), pa.int32()), pa.array(exact, pa.decimal128(38, 0))], names=["cluster", "n", "dim", "total"])


class VaFile:
    """The vectors of a table in both forms, as bucketed tables in the shared folder. ``drop`` forgets the tables' names and files."""

    def __init__(self, vectors: DataFrame, dims: int, bits: int, bucket_rows: int, id_col: str, vector_col: str):
        spark = vectors.sparkSession
        self.spark, self.dims, self.bits, self.at = spark, dims, bits, f"{common.shared_dir(spark).rstrip('/')}/va-{uuid.uuid4().hex}"
        v = F.col("v")
        whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(F.lit(1024.0) * F.greatest(F.least(x, F.lit(1e9)), F.lit(-1e9))), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
        good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(v.isNotNull() & good)
        numbered = kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("q"))
        first = common.written(numbered, "vectors")
        spread = first.agg(*(f(F.col("q")[d]).alias(f"{name}{d}") for d in range(dims) for name, f in (("low", F.min), ("high", F.max), ("mean", F.mean), ("std", F.stddev_pop))), F.count("*").alias("n")).first()
        self.n = spread["n"]
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-self.n // bucket_rows)))
        self.low, self.high, mean, std = (np.array([spread[f"{name}{d}"] or 0 for d in range(dims)], float) for name in ("low", "high", "mean", "std"))
        self.low, self.high = self.low.astype(np.int64), self.high.astype(np.int64)
        steps = np.array([NormalDist().inv_cdf(j / 2**bits) for j in range(1, 2**bits)])
        # a cell's lower end is part of it; every end is held within what occurs
        self.bounds = np.clip(np.ceil(mean[:, None] + std[:, None] * steps), self.low[:, None], self.high[:, None]).astype(np.int64)
        self.vectors = self.keep(first, "vectors")
        bounds, dims = self.bounds, self.dims

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = cells_of(matrix(b["q"], dims), bounds)
                yield pa.RecordBatch.from_arrays([b["row"], pa.array([c.tobytes() for c in cells], pa.binary())], names=["row", "cells"])

        self.cells = self.keep(common.map_arrow(first.select("row", "q"), code, "row long, cells binary"), "cells")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        table = f"{name}_{self.at.rpartition('-')[2]}"
        df.repartition(self.buckets, "row").write.bucketBy(self.buckets, "row").sortBy("row").option("path", f"{self.at}/{name}").option("compression", "zstd").saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for name in ("vectors", "cells"):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}_{self.at.rpartition('-')[2]}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def lookup(self, centroids: list[list[int]]) -> Lookup:
        return Lookup(centroids, self.bounds, self.low, self.high)

    def first_sums(self, centroids: list[list[int]]) -> DataFrame:
        """Sums and sizes of the first clusters, of all vectors."""
        now, bounds, k, dims = self.lookup(centroids), self.bounds, len(centroids), self.dims

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
            for b in batches:
                q = matrix(b["q"], dims)
                cluster, _ = now.nearest(q, now.candidates(cells_of(q, bounds)))
                more = sums(cluster, q, np.ones(len(q), np.int64), k, dims)
                n, total = n + more[0], total + more[1]
            yield sum_rows(n, total)

        return common.map_arrow(self.vectors.select("q"), add, SUMS)

    def moved_sums(self, before: list[list[int]], after: list[list[int]]) -> DataFrame:
        """What the sums and sizes of clusters gain and lose from one set of centroids to the next."""
        old, new, k, dims = self.lookup(before), self.lookup(after), len(after), self.dims

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = np.frombuffer(b"".join(b["cells"].to_pylist()), np.uint8).reshape(-1, dims)
                was, now = old.candidates(cells), new.candidates(cells)
                fetch = (was.sum(1) > 1) | (now.sum(1) > 1) | (was.argmax(1) != now.argmax(1))
                mask = lambda may: pa.array([m.tobytes() for m in np.packbits(may[fetch], axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([b["row"].filter(pa.array(fetch)), mask(was), mask(now)], names=["row", "was", "now"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
            open_ = lambda column: np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), axis=1, count=k).astype(bool)
            for b in batches:
                if len(b):
                    q = matrix(b["q"], dims)
                    was, now = old.nearest(q, open_(b["was"]))[0], new.nearest(q, open_(b["now"]))[0]
                    moved = was != now
                    ones = np.ones(moved.sum(), np.int64)
                    for cluster, sign in ((was, -ones), (now, ones)):
                        more = sums(cluster[moved], q[moved], sign, k, dims)
                        n, total = n + more[0], total + more[1]
            yield sum_rows(n, total)

        fetch = common.map_arrow(self.cells, look, "row long, was binary, now binary")
        fetched = fetch.hint("merge").join(self.vectors.select("row", "q"), "row")
        return common.map_arrow(fetched.select("q", "was", "now"), add, SUMS)

    def assigned(self, centroids: list[list[int]]) -> DataFrame:
        """vec_id, cluster and distance of every vector."""
        now, bounds, dims = self.lookup(centroids), self.bounds, self.dims

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = matrix(b["q"], dims)
                cluster, distance = now.nearest(q, now.candidates(cells_of(q, bounds)))
                yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

        return common.map_arrow(self.vectors.select("vec_id", "q"), near, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, bits: int = 8, bucket_rows: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared) and centroid (array of int) of every kept vector after ``rounds`` rounds from the ``k`` first by hash.

    A task holds ``bucket_rows`` vectors' worth of files at most and reads them in batches. The driver gets k * dims sums a round. If
    no centroid changes, later rounds would give the same and are left out.
    """
    spark, va = vectors.sparkSession, VaFile(vectors, dims, bits, bucket_rows, id_col, vector_col)
    try:
        start = va.vectors.orderBy(F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "q", "row").limit(k).select("q").collect()
        if not start:
            return spark.createDataFrame([], "vec_id long, cluster int, distance long, centroid array<int>")
        centroids, before = [list(r["q"]) for r in start], None
        size, total = [0] * len(centroids), [[0] * dims for _ in centroids]
        for _ in range(rounds):
            changes = va.first_sums(centroids) if before is None else va.moved_sums(before, centroids)
            for r in changes.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
                total[r["cluster"]][r["dim"]] += int(r["total"])
                size[r["cluster"]] += r["n"] if r["dim"] == 0 else 0
            before, centroids = centroids, [[t // n for t in ts] if n else c for c, n, ts in zip(centroids, size, total, strict=True)]
            if before == centroids:
                break
        found = common.written(va.assigned(centroids), "clusters")
    finally:
        va.drop()
    last = spark.createDataFrame(list(enumerate(centroids)), "cluster int, centroid array<int>")
    return found.join(F.broadcast(last), "cluster").select("vec_id", "cluster", "distance", "centroid")


def with_inertia(found: DataFrame) -> DataFrame:
    """The clusters' rows with cluster_inertia, inertia and centroid_sha256; sums beyond a long are null."""
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # one row a cluster
    fits = lambda x: int(x) if x < 2**63 else None
    total = fits(sum(r["s"] for r in each))
    table = found.sparkSession.createDataFrame([(r["cluster"], fits(r["s"]), total) for r in each], "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256).alias("centroid_sha256"))


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """DuckDB SQL: every round written out."""
    nearest = "SELECT v, cluster, distance FROM (SELECT x.v, c.cluster, CAST(sum((x.q - c.q) * (x.q - c.q)) AS BIGINT) AS distance FROM x JOIN {c} c USING (d) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY v ORDER BY distance, cluster) = 1"
    parts = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS v, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0)""",
        "x AS MATERIALIZED (SELECT v, d, CAST(floor(1024 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS q FROM (SELECT v, embedding, unnest(range(1, len(embedding) + 1)) AS d FROM e))",
        f"s AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster FROM e QUALIFY cluster < {k})",
        "c0 AS MATERIALIZED (SELECT cluster, d, q FROM s JOIN x USING (v))",
    ]
    for r in range(rounds):
        mean = "CAST((t - ((t % n) + n) % n) // n AS BIGINT)"
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')})")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.d, coalesce({mean}, c.q) AS q FROM c{r} c LEFT JOIN (SELECT cluster, d, sum(q) AS t, count(*) AS n FROM a{r} JOIN x USING (v) GROUP BY ALL) m ON m.cluster = c.cluster AND m.d = c.d)")
    parts.append(f"z AS MATERIALIZED ({nearest.format(c=f'c{rounds}')})")
    parts.append(f"h AS (SELECT cluster, sha256(string_agg(CAST(q AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM z JOIN e USING (v) JOIN h USING (cluster)"""
