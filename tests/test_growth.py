"""What steps move and hold, as their inputs grow."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import agglomerative, density, neighbours, setjoin, stateful
from heliograph.operators.neighbours import NeighbourGraph


@pytest.mark.parametrize("least", [0.3, 0.55, 0.7, 0.9])
def test_set_join_moves_no_pairs(spark, least):
    rnd = random.Random(7)
    sets = [(i, [f"w{min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(rnd.choice([1, 2, 3, 5, 9, 12, 24]))]) for i in range(250)]
    sets += [(1000 + i, [*s[:-1], f"w{i % 40}"]) for i, s in sets[:120]]
    df = spark.createDataFrame([*sets, (5000, []), (5001, None)], "id long, tokens array<string>")
    joined = setjoin.set_similarity_join(df, "id", "tokens", least, ["id"])
    got = [(r["a"], r["b"], r["similarity"], r["a_id"], r["b_id"]) for r in joined.collect()]
    want = [(i, j, len(set(a) & set(b)) / len(set(a) | set(b)), i, j) for i, a in sets for j, b in sets if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= least]
    assert sorted(got) == sorted(want)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\((a|b)#", plan)


def brute_force(sets, least):
    near = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    return [(min(i, j), max(i, j), near(a, b)) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if near(a, b) >= least]


def test_pairs_of_one_signature_are_not_one_tasks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 30, raising=False)
    sets = [(i, ["x", "y", "z", "u", f"w{i}", f"v{i % 50}"]) for i in range(300)]
    joined = setjoin.set_similarity_join(spark.createDataFrame(sets, "id long, tokens array<string>"), "id", "tokens", 0.5)
    got = joined.select("a", "b", "similarity", F.spark_partition_id().alias("task")).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(brute_force(sets, 0.5))
    assert max(Counter(r["task"] for r in got).values()) < 0.3 * len(got)


def test_set_join_of_long_sets_with_texts_as_keys(spark):
    rnd = random.Random(9)
    whole = [f"t{i}" for i in range(70)]
    sets = [(f"k{i}", rnd.sample(whole, rnd.randrange(20, 65))) for i in range(120)]
    got = setjoin.set_similarity_join(spark.createDataFrame(sets, "id string, tokens array<string>"), "id", "tokens", 0.6).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_force(sets, 0.6)) != []


@pytest.mark.parametrize("missing", [False, True])
def test_sets_lose_to_those_of_a_higher_rank(spark, monkeypatch, missing):
    monkeypatch.setattr(setjoin, "BLOCK", 60, raising=False)
    rnd = random.Random(11)
    sets = [(i, [f"w{min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(rnd.choice([1, 2, 3, 5, 9, 12]))]) for i in range(200)]
    sets += [(1000 + i, ["x", "y", "z", "u", "t", f"w{i % 40}", f"v{i % 9}"]) for i in range(250)]  # many at one signature
    rank = {i: None if missing and rnd.random() < 0.2 else rnd.randrange(30) for i, _ in sets}
    df = spark.createDataFrame([(i, rank[i], s) for i, s in sets], "id long, trust int, tokens array<string>")
    higher = lambda a, b: rank[a] is not None and rank[b] is not None and rank[b] > rank[a]
    want = {a if higher(a, b) else b for a, b, _ in brute_force(sets, 0.7)}
    got = [r["id"] for r in setjoin.outranked(df, "id", "tokens", 0.7, "trust").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_links_are_made_in_bounded_memory():
    n = 20_000
    v = np.random.default_rng(1).normal(size=(n, 8)).astype(np.float32)
    tracemalloc.start()
    links = neighbours.linked(v / np.linalg.norm(v, axis=1, keepdims=True), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == n and peak < 4 * neighbours.TOGETHER * n * 4  # a few blocks of similarities


def test_best_of_many_columns():
    s = np.random.default_rng(2).normal(size=(50, 5003)).astype(np.float32)
    s[:, 17] = s[:, 4000]
    for k in (1, 7, 33, 200):
        at = neighbours.best(s, k)
        assert (np.take_along_axis(s, at, 1) == -np.sort(-s, axis=1)[:, :k]).all() and all(len(set(a)) == k for a in at.tolist())


def test_index_without_links_is_exact(spark):
    x = np.random.default_rng(3).normal(size=(900, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    got = {}
    index = NeighbourGraph.build(rows, keep=["label"], links=0, part_rows=500)
    for r in index.near_pairs(5).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    assert got == {i: set(np.argsort(-s[i])[:5].tolist()) for i in range(len(x))}
    other = index.search(rows.withColumnRenamed("vec_id", "query_id"), 1, apart="label").collect()
    s[np.arange(900)[:, None] % 2 == np.arange(900)[None, :] % 2] = -2
    assert {r["query_id"]: r["vec_id"] for r in other} == {i: int(s[i].argmax()) for i in range(len(x))}


def test_dense_rows_that_know_all_near_rows_ask_no_more(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(size=(8, 8)) * 0.01 for c in rng.normal(size=(6, 8))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(density, "outside", lambda *_, **__: pytest.fail("asked"))
    found = density.dense_clusters(NeighbourGraph.build(rows), 0.01, 5, neighbours=12).collect()
    assert {r["node"]: r["component"] for r in found} == {i: i // 8 * 8 for i in range(48)}


def test_ward_ends_in_one_task_with_the_merges_of_its_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)], "vec_id long, embedding array<double>")
    near = {(3 * i, 3 * int(j)) for i, v in enumerate(x) for j in np.argsort(((x - v) ** 2).sum(1))[1:6]}
    links = spark.createDataFrame([*near, (0, 1000)], "u long, v long")
    ran = []
    kept = agglomerative.kept
    monkeypatch.setattr(agglomerative, "kept", lambda df: ran.append(1) or kept(df))
    found = []
    for few in (4096, 25, 0):  # at once, after some rounds, never
        monkeypatch.setattr(agglomerative, "CLUSTERS", few)
        ran.append(0)
        found.append(sorted((r["a"], r["b"], r["size"], round(r["height"], 9)) for r in agglomerative.ward_merges(rows, links).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) >= 50
    assert sum(ran[1 : ran.index(0, 1)]) <= 4 < sum(ran[ran.index(0, 1) :])


def test_a_users_classes_are_one_group_of_state(spark):
    joined = spark.readStream.format("rate").load().selectExpr("value AS user_id", "'a' AS class", "0.5 AS p", "true AS right", "timestamp AS told", "value AS outcome_id")
    plan = stateful.user_temperatures(joined)._jdf.queryExecution().analyzed().toString()
    assert re.search(r"FlatMapGroupsInPandasWithState step\(user_id#\d+L, class#", plan) and not re.search(r"\[user_id#\d+L, class#\d+\], ", plan)
