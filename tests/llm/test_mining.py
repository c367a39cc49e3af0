"""Collocations, languages and centroid clusters against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from heliograph.llm import collocations, language, vafile
from tests.llm.test_contracts import empty_table, odd_table

LETTERS = "ab cde"


def brute_collocations(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        kept = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            l, r, score = min(((c[p[:k]], c[p[k:]], 1000000 * a * a // (c[p[:k]] * c[p[k:]])) for k in range(1, len(p))), key=lambda x: x[2])
            longer = [b for q, b in c.items() if len(q) == 3 and len(p) == 2 and b >= least and p in (q[:2], q[1:])]
            if all(100 * b < share * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def test_collocations_against_brute_force(spark):
    rnd = random.Random(7)
    words = ["The", "the", "of", "ÉTÉ", "été", "x", "long" * 30, "a-b", " ", "z"]
    rows = [(rnd.choice(["en", "en", "de", None]), "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", ";", "\r"]) for _ in range(rnd.randint(0, 80)))) for _ in range(120)]
    rows += [("en", None), ("fr", ""), (None, "the of x " * 4000), ("en", "y" * 300_000 + " q")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(map(tuple, collocations.collocations(docs, least=5, top=40).collect()))
    assert got == brute_collocations(rows, 5, 50, 40)
    small = collocations.phrase_counts(docs, 5, 3, flush=500, bucket_bytes=300)
    assert sorted(map(tuple, small.where("words > 0").collect())) == sorted(map(tuple, collocations.phrase_counts(docs, 5, 3).where("words > 0").collect()))


def test_collocations_of_four_words(spark):
    docs = spark.createDataFrame([("en", "a b c d. " * 12 + "a b. " * 30)], "lang string, text string")
    got = {r["phrase"] for r in collocations.collocations(docs, most=4).collect()}
    assert got == {"a b c d", "a b"}


def test_collocation_scores_past_64_bits(spark):
    keys = [np.zeros(3, np.int64), np.ones(3, np.int64)]
    assert [w.tolist() for _, w in collocations.multikey_quicksort(keys, np.array([2**40] * 3), 10)] == [[3 * 2**40]] * 2
    assert collocations.collocations(empty_table(spark)).count() == 0
    assert collocations.collocations(odd_table(spark)).count() > 0


def test_quicksort_counts():
    rng = np.random.default_rng(3)
    keys = [(rng.zipf(1.4, 3000) % 50).astype(np.int64) for _ in range(3)]
    keys[2][rng.random(3000) < 0.2] = -1
    sizes = rng.integers(1, 5, 3000)
    for d, (heads, weight) in enumerate(collocations.multikey_quicksort(keys, sizes, 10)):
        want = Counter()
        for *k, n in zip(*keys[: d + 1], sizes, strict=True):
            if k[-1] >= 0:
                want[tuple(k)] += n
        assert {tuple(k[h] for k in keys[: d + 1]): w for h, w in zip(heads, weight, strict=True)} == {k: v for k, v in want.items() if v >= 10}


def sentences(seed, n):
    """Words with endings of four made-up languages, two of which share most letters."""
    rnd = random.Random(seed)
    parts = {"aa": ["ing", "the", "er", "sh"], "bb": ["ung", "die", "er", "sch"], "cc": ["ção", "os", "er"], "dd": ["ский", "не", "ов"]}
    return [(lang, " ".join("".join(rnd.choices(p, k=rnd.randint(1, 3))) for _ in range(rnd.randint(2, 40)))) for lang, p in parts.items() for _ in range(n)]


def test_languages_learned_and_calibrated(spark):
    model = language.fit(spark.createDataFrame(sentences(1, 200), "lang string, text string"))
    held = spark.createDataFrame([(i, *r) for i, r in enumerate(sentences(2, 100))], "id long, lang string, text string")
    found = language.predict(held, model, "text", held["id"], held["lang"]).collect()
    right = [r["lang"] == r["lang_pred"] for r in found]
    assert sum(right) / len(right) > 0.97
    assert abs(sum(r["score"] for r in found) / len(found) - sum(right) / len(right)) < 0.05
    assert (model.w == 0).mean() > 0.9  # L1 leaves few weights


def test_languages_of_awkward_tables(spark):
    df = odd_table(spark)
    model = language.fit(df.selectExpr("text", "if(doc_id % 2 = 0, 'en', 'fr') AS lang"))
    got = language.predict(df, model, "text", df["doc_id"], df["found"]).collect()
    assert len(got) == df.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und")
    texts = {r["doc_id"]: r["text"] for r in df.where("doc_id IS NOT NULL").collect()}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))
    none = language.fit(empty_table(spark).select("text", "lang"))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(df, none, "text").collect()} == {("und", 0.0)}
    assert language.predict(empty_table(spark), model, "text").count() == 0
    one = language.fit(df.selectExpr("text", "'en' AS lang"))
    assert one.predict("hello") == ("en", 1.0)


def test_document_frequencies_cover_all_texts(spark):
    df = spark.createDataFrame(sentences(3, 30), "lang string, text string").repartition(5)
    want = Counter(int(x) for r in df.collect() for x in language.counts(r["text"], 15)[0])
    assert {r["feature"]: r["n"] for r in language.document_frequencies(df, 15).collect()} == want
    long = "abc " * 100_000 + "ж"
    at, n = language.counts(long, 15)
    assert n.sum() == 300_001 + 2 * 400_001 + 1 - 1 or n.max() >= 100_000
    assert set(language.counts("ж", 15)[0]) <= set(at)


def brute_clusters(rows, k, rounds):
    kept = [(i, np.array([int(np.floor(1024 * float(x))) for x in v], object)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), list(r[1])))[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        centroids = [sum(v for (_, v), a in zip(kept, at, strict=True) if a == j) // at.count(j) if j in at else c for j, c in enumerate(centroids)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in kept)


@pytest.mark.parametrize("bits", [3, 8])
def test_clusters_against_brute_force(spark, bits):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 0.2, (5, 64))
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(0, 0.1, 64)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, [0.0] * 64), (500, None), (501, [1.0] * 63), (502, [1.0] * 63 + [None]), (503, [1.0] * 63 + [float("nan")]), (504, [float("inf")] + [1.0] * 63), (505, [9.5] * 64), (506, [-0.0005] * 64)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, row string")
    got = vafile.with_inertia(vafile.cluster(df, bits=bits)).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == brute_clusters(rows, 8, 10)
    assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.5] * 64) for i in range(3)]
    schema = "vec_id long, embedding array<float>"
    got = vafile.cluster(spark.createDataFrame(rows, schema)).collect()
    assert [(r["cluster"], r["distance"]) for r in got] == [(0, 0)] * 3
    assert vafile.with_inertia(vafile.cluster(spark.createDataFrame([], schema))).count() == 0
    huge = vafile.cluster(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], schema), k=1, rounds=2)
    assert vafile.with_inertia(huge).count() == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("vectors_", "cells_"))]


def test_rounds_do_not_shuffle_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 7)] * 64) for i in range(200)], "vec_id long, embedding array<double>")
    va = vafile.VaFile(df, 64, 8, 1_000_000, "vec_id", "embedding")
    try:
        plan = va.moved_sums([[0] * 64, [900] * 64], [[0] * 64, [2000] * 64])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert plan.count("Exchange\n") <= 1 or plan.count("hashpartitioning") == 1
    finally:
        va.drop()
