"""Neighbour graphs, density trees, dense clusters and communities against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import communities, density, vectors
from heliograph.operators.neighbours import NeighbourGraph


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in v], i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")


def blobs(n, groups, dims, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return np.concatenate([centres[np.arange(n) % groups] + rng.normal(size=(n, dims)) * spread, rng.normal(size=(n // 10, dims))])


def recall(index, queries, rows, k, **options):
    got, true = {}, {}
    for r in index.search(queries, k, **options).collect():
        got.setdefault(r["query_id"], []).append(r["similarity"])
    for r in vectors.knn(rows, queries, k).collect():
        true.setdefault(r["query_id"], []).append(r["similarity"])
    return sum(s >= min(t) - 1e-5 for q, t in true.items() for s in got.get(q, [])) / sum(map(len, true.values()))


@pytest.mark.parametrize("part_rows", [300, 5000])
def test_graph_index_saved_loaded_and_searched(spark, tmp_path, part_rows):
    rows = frame(spark, blobs(1500, 40, 16, 0.3, 1))
    path = str(tmp_path / "index")
    built = NeighbourGraph.build(rows, keep=["label"], part_rows=part_rows).save(path)
    assert built.rows.count() == rows.count()
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    loaded = NeighbourGraph.load(spark, path)
    assert recall(loaded, queries, rows, 10) >= 0.9
    few = loaded.search(queries, 5, where=F.col("label") == 1)
    labels = {r["vec_id"]: r["label"] for r in rows.collect()}
    assert {labels[r["vec_id"]] for r in few.collect()} == {1}
    assert few.count() == 5 * queries.count()


def test_graph_index_of_copies_and_awkward_rows(spark):
    rows = frame(spark, np.repeat(np.random.default_rng(2).normal(size=(20, 8)), 40, 0))
    odd = spark.createDataFrame([(9000, None, 1), (9001, [0.0] * 8, 1)], rows.schema)
    index = NeighbourGraph.build(rows.unionByName(odd))
    found = index.search(rows.where("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id"), 10).collect()
    assert len(found) == 200 and all(r["similarity"] > 0.999 for r in found)
    none = NeighbourGraph.build(rows.where("false"))
    assert none.rows.count() == 0


def mutual(x, least_samples):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.maximum(1 - u.astype(np.float32) @ u.astype(np.float32).T, density.LEAST).astype(float)
    np.fill_diagonal(d, np.inf)
    if least_samples > 1:
        core = np.sort(d, axis=1)[:, least_samples - 1]
        d = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    return d


def brute_tree(d):
    n, inside, out = len(d), {0}, []
    while len(inside) < n:
        rest = [i for i in range(n) if i not in inside]
        sub = d[np.ix_(sorted(inside), rest)]
        i, j = np.unravel_index(sub.argmin(), sub.shape)
        out.append((sub.min(), sorted(inside)[i], rest[j]))
        inside.add(rest[j])
    return out


def brute_clusters(edges, n, smallest):
    """From the root down: cut the longest edge; parts that are too small fall out of their cluster."""
    stability, below, points = {}, {}, {}
    stack, names = [(frozenset(range(n)), sorted(edges), None, None)], itertools.count()
    tops = {}

    def parts(nodes, tree):
        seen, out = set(), []
        near = {v: [] for v in nodes}
        for _, a, b in tree:
            near[a].append(b)
            near[b].append(a)
        for v in nodes:
            if v not in seen:
                todo, got = [v], {v}
                while todo:
                    for w in near[todo.pop()]:
                        if w not in got:
                            got.add(w)
                            todo.append(w)
                seen |= got
                out.append(frozenset(got))
        return out

    def grow(nodes, tree, born, parent):
        name, left, now = next(names), [], nodes
        below[name], points[name], tops[name] = [], nodes, parent
        while True:
            w = tree[-1][0]
            a, b = parts(now, tree[:-1])
            big = [p for p in (a, b) if len(p) >= smallest]
            if len(big) == 2 or not big:
                left += [1 / w - born] * len(now)
                for p in big:
                    below[name].append(grow(p, [e for e in tree[:-1] if e[1] in p], 1 / w, name))
                break
            left += [1 / w - born] * (len(now) - len(big[0]))
            now, tree = big[0], [e for e in tree[:-1] if e[1] in big[0]]
        stability[name] = sum(left)
        return name

    root = grow(*stack[0][:2], 0.0, None)
    worth = {}
    for c in sorted(below, reverse=True):
        worth[c] = max(stability[c], sum(worth[x] for x in below[c]))
    out, todo = set(), list(below[root])
    while todo:
        c = todo.pop()
        if stability[c] >= sum(worth[x] for x in below[c]):
            out.add(points[c])
        else:
            todo += below[c]
    return out


@pytest.mark.parametrize("least_samples, smallest, block", [(1, 2, 10**6), (4, 5, 60)])
def test_density_tree_against_brute_force(spark, least_samples, smallest, block):
    import sys

    sys.setrecursionlimit(10000)
    x = blobs(220, 6, 8, 0.25, 4)
    d = mutual(x, least_samples)
    index = NeighbourGraph.build(frame(spark, x))
    tree = brute_tree(d)
    got = density.spanning_tree(index, 6, least_samples).collect()
    assert len(got) == len(x) - 1
    assert sum(r["w"] for r in got) == pytest.approx(sum(w for w, _, _ in tree), rel=1e-4)
    found = {}
    for r in density.tree_clusters(index, smallest, least_samples, 6, block).collect():
        found.setdefault(r["cluster"], set()).add(r["node"])
    want = brute_clusters([(w, int(a), int(b)) for w, a, b in tree], len(x), smallest)
    assert {frozenset(c) for c in found.values()} == want
    assert all(c == min(v) for c, v in found.items())


def test_spanning_tree_asks_only_unsure_rows(spark, monkeypatch):
    """Rows whose known edges reach as far as their component's least one aren't searched again; the tree is as long as by brute force."""
    x, asked, search = blobs(400, 5, 8, 0.25, 9), [], NeighbourGraph.search

    def counted(self, queries, *args, **options):
        if options.get("apart"):
            asked.append(queries.count())
        return search(self, queries, *args, **options)

    monkeypatch.setattr(NeighbourGraph, "search", counted)
    got = density.spanning_tree(NeighbourGraph.build(frame(spark, x), links=0), 6).collect()
    assert len(got) == len(x) - 1
    assert sum(r["w"] for r in got) == pytest.approx(sum(w for w, _, _ in brute_tree(mutual(x, 1))), rel=1e-4)
    assert asked and sum(asked) < len(x), asked


def test_dense_clusters_against_brute_force(spark):
    x = blobs(300, 5, 8, 0.3, 6)
    d = mutual(x, 1)
    np.fill_diagonal(d, 0)
    eps, least = 0.08, 5
    core = (d <= eps).sum(1) >= least
    comp = {i: i for i in np.flatnonzero(core)}
    for _ in range(len(x)):
        comp = {i: min(comp[j] for j in comp if d[i, j] <= eps) for i in comp}
    found = {r["node"]: r["component"] for r in density.dense_clusters(NeighbourGraph.build(frame(spark, x)), eps, least, neighbours=6).collect()}
    assert {i: found[i] for i in comp} == comp
    for i in np.flatnonzero(~core):
        near = [j for j in comp if d[i, j] <= eps]
        assert (i in found) == bool(near)
    got = {r["component"]: r for r in density.cluster_figures(frame(spark, x), spark.createDataFrame([(int(k), int(v)) for k, v in found.items()], "node long, component long")).collect()}
    for c, r in got.items():
        m = x[[i for i in found if found[i] == c]]
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        pairs = (u @ u.T)[~np.eye(len(u), dtype=bool)]
        assert r["size"] == len(m) and np.allclose(r["centroid"], m.mean(0))
        assert r["coherence"] == pytest.approx(pairs.mean()) and r["density"] == pytest.approx(1 / (np.linalg.norm(m - m.mean(0), axis=1).mean() + 1e-8))


def quality(edges, comm, resolution=1.0):
    total = sum(w for *_, w in edges)
    inside = sum(w for a, b, w in edges if comm[a] == comm[b])
    k = {}
    for a, b, w in edges:
        k[comm[a]] = k.get(comm[a], 0) + w
        k[comm[b]] = k.get(comm[b], 0) + w
    return inside / total - resolution * sum((x / (2 * total)) ** 2 for x in k.values())


def partitions(nodes):
    if not nodes:
        yield {}
        return
    for rest in partitions(nodes[1:]):
        for c in sorted(set(rest.values())) + [nodes[0]]:
            yield {**rest, nodes[0]: c}


def connected(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b, _ in edges:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    todo, seen = [next(iter(nodes))], set()
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near[x]
    return seen == set(nodes)


@pytest.mark.parametrize("seed", [0])
def test_communities_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    edges = [(a, b, float(rnd.choice([1, 2]))) for a in range(8) for b in range(a) if rnd.random() < (0.9 if a // 4 == b // 4 else 0.25)]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    best = max(quality(edges, p) for p in partitions(nodes))
    odd = [(None, 1, 1.0), (1, 2, -1.0), (1, 3, None)]
    found = {r["node"]: r["community"] for r in communities.communities(spark.createDataFrame(edges + odd, "src long, dst long, weight double")).collect()}
    assert sorted(found) == nodes
    assert quality(edges, found) >= 0.98 * best
    for c in set(found.values()):
        members = [n for n in found if found[n] == c]
        assert min(members) == c and connected(members, edges)


def test_communities_of_planted_groups_and_figures(spark):
    rnd = random.Random(3)
    edges = [(a, b, 1.0) for a in range(120) for b in range(a) if rnd.random() < (0.4 if a % 6 == b % 6 else 0.02)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    found = communities.communities(df)
    comm = {r["node"]: r["community"] for r in found.collect()}
    assert quality(edges, comm) >= 0.98 * quality(edges, {i: i % 6 for i in range(120)})
    figures = communities.modularity(df, spark.createDataFrame(list(comm.items()), "node long, community long")).collect()
    assert sum(r["modularity"] for r in figures) == pytest.approx(quality(edges, comm))
    assert sum(r["internal_edges"] for r in figures) + sum(r["external_edges"] for r in figures) / 2 == len(edges)
    assert communities.communities(df.where("false")).count() == 0


def test_last_levels_in_one_task_are_the_same(spark):
    rnd = random.Random(11)
    edges = [(a, b, rnd.random()) for a in range(150) for b in range(a) if rnd.random() < (0.3 if a % 15 == b % 15 else 0.02)]
    df = spark.createDataFrame([*edges, (900, 900, 1.0)], "src long, dst long, weight double")
    whole, ended = ({r["node"]: r["community"] for r in communities.communities(df, rounds=1, levels=2, last=last).collect()} for last in (-1, 1_000_000))
    assert whole == ended and set(whole) == {x for a, b, _ in edges for x in (a, b)} | {900} and 1 < len(set(whole.values())) < 100


def brute_ward(x):
    clusters, out = {i: (1, v) for i, v in enumerate(x)}, []
    while len(clusters) > 1:
        d, a, b = min((np.sqrt(2 * n * m / (n + m) * ((c - e) ** 2).sum()), a, b) for (a, (n, c)), (b, (m, e)) in itertools.combinations(sorted(clusters.items()), 2))
        (n, c), (m, e) = clusters[a], clusters.pop(b)
        clusters[a] = (n + m, (n * c + m * e) / (n + m))
        out.append((a, b, n + m, d))
    return out


def test_ward_against_brute_force(spark):
    from heliograph.operators import agglomerative

    x = blobs(60, 4, 5, 0.4, 9)
    links = spark.createDataFrame(list(itertools.combinations(range(len(x)), 2)), "u long, v long")
    got = agglomerative.ward_merges(frame(spark, x), links).collect()
    want = brute_ward(x)
    assert sorted((r["a"], r["b"], r["size"]) for r in got) == sorted(w[:3] for w in want)
    assert np.allclose(sorted(r["height"] for r in got), sorted(w[3] for w in want))
    comp = {i: i for i in range(len(x))}
    for a, b, *_ in sorted(want, key=lambda w: w[3])[: len(x) - 4]:
        comp = {i: a if c == b else c for i, c in comp.items()}
    cut = agglomerative.ward_clusters(frame(spark, x), links, 4).collect()
    assert {r["node"]: r["cluster"] for r in cut} == comp
