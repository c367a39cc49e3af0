"""Vector search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graphs import connected_components
from .state import cut, written


def knn(rows: DataFrame, queries: DataFrame, k: int, row_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", block: int = 256, part_rows: int = 20_000) -> DataFrame:
    """The k rows nearest to each query by cosine, exactly: query_id, row_id, similarity, rank.

    Queries go in blocks of about ``block``: rows are dealt into parts of about ``part_rows`` at random, and each part meets each block of queries
    in one group, as matrices. A group gives only its k best rows for each query. Vectors without length have
    similarity 0.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    parts = max(8, -(-rows.count() // part_rows))
    n_blocks = max(1, -(-queries.count() // block))
    dealt_rows = rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(row_id), F.lit(parts)).alias("part"))
    each = dealt_rows.select("id", "v", "part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    dealt_queries = queries.select(F.col(query_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(query_id), F.lit(n_blocks)).cast("int").alias("block"))
    spread = dealt_queries.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "block")

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        x = np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            ids, sims = np.array(left["id"]), unit(right["v"]) @ unit(left["v"]).T
            for q, s in zip(right["id"].to_pylist(), sims, strict=True):
                best = np.lexsort((ids, -s))[:k]
                found += [(q, int(ids[i]), float(s[i])) for i in best]
        return pa.table({n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate((("query_id", pa.int64()), (row_id, pa.int64()), ("similarity", pa.float64())))})

    met = each.groupBy("part", "block").cogroup(spread.groupBy("part", "block")).applyInArrow(near, f"query_id long, {row_id} long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), row_id)
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def products(x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``at`` of x and ``to`` of y, summed in one order however rows are dealt."""
    s = np.zeros(len(at))
    for d in range(x.shape[1]):
        s += x[at, d].astype(np.float64) * y[to, d]
    return s


def best_products(rows: DataFrame, queries: DataFrame, k: int, row_id: str = "id", query_id: str = "query_id", vector: str = "features", head: int = 4096, part_rows: int = 16_384, block: int = 20_000) -> DataFrame:
    """The k rows with the largest inner product with each query, exactly: query_id, row_id, score, rank; of equals the smaller row_id.

    Every query meets the ``head`` longest rows first. The others are dealt by length into parts, and a query meets a part only if its length times that of
    the part's longest row reaches its k-th best score so far. A part and about ``block`` queries are one group, which gives only rows that reach the queries' scores.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    v = F.col(vector).cast("array<float>")
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("length")
    items = rows.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("id"), v.alias("v"), length)
    first = items.orderBy(F.desc("length"), "id").limit(head).collect()
    ids, longest = np.array([r["id"] for r in first], np.int64), np.array([r["v"] for r in first], np.float32)
    n, asked_n = rows.count(), queries.count()
    blocks = max(1, -(-asked_n // block))

    def matrix(column) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(flat.flatten(), np.float32).reshape(len(flat), -1)

    def reached(q: np.ndarray, x: np.ndarray, names: np.ndarray, floor: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, names of rows and scores, the best k of each query, among those that reach ``floor``."""
        s = q @ x.T
        slack = 2e-7 * x.shape[1] * np.abs(q).max(1, initial=0) * np.abs(x).sum(1).max(initial=0)  # what float32 may be off
        least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1] if floor is None else floor
        at, to = np.nonzero(s >= (least - 2 * slack)[:, None])
        score, name = products(q, x, at, to), names[to]
        if floor is not None:
            at, name, score = (c[score >= floor[at]] for c in (at, name, score))
        order = np.lexsort((name, -score, at))
        at, name, score = at[order], name[order], score[order]
        start = np.searchsorted(at, at)
        return tuple(c[np.arange(len(at)) - start < k] for c in (at, name, score))

    def begin(batches):
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                at, name, score = reached(matrix(b["v"]), longest, ids, None)
                offsets = np.searchsorted(at, np.arange(b.num_rows + 1)).astype(np.int32)
                floor = [score[e - 1] if e - o >= k else -np.inf for o, e in zip(offsets, offsets[1:], strict=False)]
                best = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(name, pa.int64()), pa.array(score)], ["id", "score"]))
                yield pa.RecordBatch.from_arrays([b["query"], b["v"], b["length"], pa.array(floor, pa.float64()), best], names=["query", "v", "length", "floor", "best"])

    known = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias("query"), v.alias("v"), length)
    if not first:
        return known.select(F.col("query").alias(query_id), F.lit(0).cast("long").alias(row_id), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    known = written(known.mapInArrow(begin, "query long, v array<float>, length double, floor double, best array<struct<id:long,score:double>>"), "products")
    found = known.select("query", F.explode("best").alias("b")).select("query", "b.id", "b.score")
    if n > len(first):
        last = first[-1]
        rest = items.where((F.col("length") < last["length"]) | ((F.col("length") == last["length"]) & (F.col("id") > last["id"])))
        rest = written(rest.repartitionByRange(-(-n // part_rows), F.desc("length"), "id").withColumn("part", F.spark_partition_id()), "parts")
        reach = rest.groupBy(F.col("part").alias("near")).agg(F.max("length").alias("most"))
        asked = known.crossJoin(F.broadcast(reach)).where(F.col("length") * F.col("most") * (1 + 1e-9) >= F.col("floor"))
        asked = asked.select("query", "v", "floor", "near", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"))
        groups = asked.select(F.col("near").alias("part"), F.col("block").alias("asks")).distinct()

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if len(left) and len(right):
                x, q, names = matrix(left["v"]), matrix(right["v"]), np.array(left["id"])
                who, floor = np.array(right["query"]), np.array(right["floor"])
                for i in range(0, len(who), 256):
                    at, name, score = reached(q[i : i + 256], x, names, floor[i : i + 256])
                    out.append((who[i + at], name, score))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
            return pa.table({c: pa.array(y, t) for c, y, t in zip(("query", "id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

        each = rest.join(groups, "part").groupBy("part", "asks")
        found = found.unionByName(each.cogroup(asked.groupBy("near", "block")).applyInArrow(meet, "query long, id long, score double"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), F.col("id").alias(row_id), "score", "rank")


def block_pairs(rows: DataFrame, n: int, block: int, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, row_id: str, vector: str, *others: str) -> DataFrame:
    """``fn`` over every unordered pair of blocks of about ``block`` of the ``n`` rows, a block with itself included; all pairs of rows meet once."""
    blocks = max(1, -(-n // block))
    b, o = F.pmod(F.xxhash64(row_id), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("o")
    dealt = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"), *others, b).select("*", o)
    dealt = dealt.select("id", "v", *others, "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def meet(t: pa.Table) -> pa.Table:
        at, i, j = np.array(t["b"]), t["i"][0].as_py(), t["j"][0].as_py()
        return fn(t.filter(pa.array(at == i)), t.filter(pa.array(at == j)))

    return dealt.repartition(max(1, min(2000, blocks * (blocks + 1) // 2)), "i", "j").groupBy("i", "j").applyInArrow(meet, schema)


def close(left: pa.Table, right: pa.Table, eps: float) -> np.ndarray:
    """Which rows of the two tables are within cosine distance ``eps``; a row is always close to itself."""

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        x = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    return (1 - unit(left["v"]) @ unit(right["v"]).T <= eps) | (np.array(left["id"])[:, None] == np.array(right["id"])[None, :])


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Links (left, right) of a spanning forest of a bipartite graph, each row of the matrix read once."""
    found, open_left, open_right = [], np.ones(links.shape[0], bool), links.any(0)
    for root in range(links.shape[0]):
        todo = [root] if open_left[root] else []
        open_left[root] = False
        while todo:
            a = todo.pop()
            for b in np.flatnonzero(links[a] & open_right):
                open_right[b] = False
                found.append((a, int(b)))
                more = np.flatnonzero(links[:, b] & open_left)
                open_left[more] = False
                found += [(int(x), int(b)) for x in more]
                todo += more.tolist()
    return found


def density_clusters(rows: DataFrame, eps: float = 0.5, least: int = 5, row_id: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """DBSCAN by cosine distance over all rows, exactly: node and component (its smallest core row); noise has no row.

    A row with ``least`` rows within ``eps``, itself included, is a core row. All pairs are compared, twice, in blocks;
    a pair of blocks gives counts and then only a spanning forest of its links. A row that isn't core has fewer than ``least``
    links and goes to the component with the smallest core row that it is close to.
    """
    n = rows.count()

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        links = close(left, right, eps)
        ids, sums = list(left["id"].to_pylist()), list(links.sum(1))
        if left["b"][0] != right["b"][0]:
            ids, sums = ids + right["id"].to_pylist(), sums + list(links.sum(0))
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(map(int, sums), pa.int64())})

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        links, a, b = close(left, right, eps), np.array(left["id"]), np.array(right["id"])
        core_a, core_b = np.array(left["core"]), np.array(right["core"])
        found = forest(links & core_a[:, None] & core_b[None, :])
        src, dst, edge = [int(a[x]) for x, _ in found], [int(b[y]) for _, y in found], [True] * len(found)
        x, y = np.nonzero(links & ~core_a[:, None] & core_b[None, :])
        src, dst = src + a[x].tolist(), dst + b[y].tolist()
        x, y = np.nonzero(links & core_a[:, None] & ~core_b[None, :])
        src, dst = src + b[y].tolist(), dst + a[x].tolist()
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "core": pa.array(edge + [False] * (len(src) - len(edge)), pa.bool_())})

    def some(fn: Callable[[pa.Table, pa.Table], pa.Table], empty: dict[str, pa.DataType]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda left, right: fn(left, right) if len(left) and len(right) else pa.table({c: pa.array([], t) for c, t in empty.items()})

    v = rows.select(row_id, vector)
    counted = block_pairs(v, n, block, some(count, {"id": pa.int64(), "n": pa.int64()}), "id long, n long", row_id, vector)
    cores = cut(counted.groupBy("id").agg((F.sum("n") >= least).alias("core")))
    flagged = v.join(cores.withColumnRenamed("id", row_id), row_id)
    links = cut(block_pairs(flagged, n, block, some(link, {"src": pa.int64(), "dst": pa.int64(), "core": pa.bool_()}), "src long, dst long, core boolean", row_id, vector, "core"))
    found = connected_components(links.where("core").select("src", "dst"))
    border = links.where("NOT core").join(found.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("component"))
    return found.unionByName(border)


def ivf_index(rows: DataFrame, lists: int = 16, sample_rows: int = 20_000, seed: int = 42, row_id: str = "vec_id", vector: str = "embedding"):
    """Inverted lists for approximate search: centroids, fitted to at most about ``sample_rows`` unit vectors, and every row with its nearest one.

    Returns the centroids (``lists`` arrays, a fixed number, held by the driver) and the rows with column ``list``.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions import scores

    v = F.col(vector).cast("array<double>")
    size = F.sqrt(scores.dot(v, v))
    unit = rows.select(row_id, vector, F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v).alias("unit"))
    n = max(1, rows.count())
    sample = unit.select(array_to_vector("unit").alias("features")).sample(min(1.0, sample_rows / n), seed)
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(sample)
    indexed = model.transform(unit.withColumn("features", array_to_vector("unit"))).select(row_id, vector, "unit", F.col("prediction").alias("list"))
    return [list(map(float, c)) for c in model.clusterCenters()], indexed


def ivf_search(centroids: list, indexed: DataFrame, queries: DataFrame, k: int, probes: int = 10, row_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """The k best rows among the ``probes`` lists nearest to each query: query_id, row_id, similarity, rank. Lists are met by an equi-join on the list."""
    from ..functions import scores

    v = F.col(vector).cast("array<double>")
    near = F.array(*(F.struct((-scores.dot(v, F.array(*map(F.lit, c)))).alias("d"), F.lit(i).alias("list")) for i, c in enumerate(centroids)))
    probed = queries.select(F.col(query_id).alias("query_id"), v.alias("q"), F.explode(F.slice(F.array_sort(near), 1, probes)).alias("p")).select("query_id", "q", F.col("p.list").alias("list"))
    found = probed.join(indexed, "list").select("query_id", row_id, scores.cosine(F.col("q"), F.col("unit")).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), row_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
