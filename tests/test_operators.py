"""Operators that SQL can't check, against plain Python."""

import math
import random
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import functions as F

from heliograph.functions import rules
from heliograph.operators import evaluation, folds, graphs, relational, setjoin, sketches, vectors, workflows
from heliograph.sources import connectors, sinks


def test_fingerprint_dedup_chain(spark):
    t0 = datetime(2024, 1, 15, 12)
    hours = [0, 10, 23, 25, 47, 50, 60, 74]
    rows = [("u", "p", "a", None, None, f"same text of some length {'x' * 20}", 0, False, t0 + timedelta(hours=h)) for h in hours]
    df = spark.createDataFrame(rows, "user_id string, platform string, author string, url string, title string, raw_text string, engagement int, is_trending boolean, seen_at timestamp")
    got = {r["seen_at"]: r["drop_stage"] for r in relational.acquisition_filter(df).collect()}
    kept, last = [], None
    for h in hours:
        if last is None or h - last >= 24:
            kept.append(h)
            last = h
    assert [h for h in hours if got[t0 + timedelta(hours=h)] is None] == kept


def test_ordered_fold_restarts_per_key(spark):
    df = spark.createDataFrame([(k, i, float(i)) for k in "abc" for i in range(50)], "k string, i int, x double")
    out = folds.ordered_fold(df, ["k"], ["i"], lambda: 0.0, lambda s, r: (s + r["x"], {"total": s + r["x"]}), "total double")
    assert {(r["k"], r["total"]) for r in out.where("i = 49").collect()} == {(k, sum(range(50)) * 1.0) for k in "abc"}


def test_knn_is_exact(spark):
    rnd = random.Random(1)
    data = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = vectors.knn(df, df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 7, block=3, part_rows=40)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / n if (n := math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))) else 0.0
    want = {(q, r) for q, v in data if q % 50 == 0 for r in [i for i, _ in sorted(((i, cos(v, w)) for i, w in data), key=lambda x: (-round(x[1], 12), x[0]))[:7]]}
    assert {(r["query_id"], r["vec_id"]) for r in got.collect()} == want


def test_set_join_is_complete(spark):
    rnd = random.Random(2)
    sets = [(i, sorted({rnd.randrange(12) for _ in range(rnd.randint(0, 9))} | {99})) for i in range(80)]
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets], "id long, tokens array<string>")
    got = {(r["a"], r["b"]) for r in setjoin.set_similarity_join(df, "id", "tokens", 0.6).collect()}
    want = {(i, j) for i, a in sets for j, b in sets if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6}
    assert got == want


def test_shortest_path(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4)], "src long, dst long")
    assert graphs.shortest_path(e, 1, 4) == [1, 5, 4]
    assert graphs.shortest_path(e, 1, 1) == [1]
    assert graphs.shortest_path(e, 4, 1) is None


def test_components_of_chain_and_loop(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graphs.connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_sketch_bounds(spark):
    df = spark.range(3000).select((F.col("id") % 100).alias("x"))
    est = sketches.estimates(df.distinct(), "x", sketches.count_min(df, F.col("x")))
    assert est.where("estimate < 30").count() == 0
    bits, k = sketches.bloom_size(1000, 0.01)
    filt = sketches.bloom(spark.range(500), F.col("id"), bits, k)
    asked = sketches.might_contain(spark.range(3000), F.col("id"), "id", filt, bits, k)
    assert asked.where("id < 500 AND NOT maybe").count() == 0
    assert asked.where("id >= 500 AND maybe").count() < 100
    assert sketches.reservoir(df.withColumn("id", F.monotonically_increasing_id()), 10, 1, "id").count() == 10


def test_ece_leaves_one_out(spark):
    df = spark.createDataFrame([(0.05, 0), (0.95, 1), (1.0, 0)], "p double, y int")
    assert evaluation.ece(df, "p", "y", 10).first()[0] == pytest.approx((0.05 + 0.05) / 3)


def test_feeds_and_json(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<rss><channel><item><guid>1</guid><title>One &amp; two</title><description><![CDATA[Body <b>x</b>]]></description><link>http://a/1</link><enclosure url="u" type="audio/mpeg"/><pubDate>Mon, 15 Jan 2024 12:00:00 GMT</pubDate></item>
<item><guid>2</guid><title>Old</title><pubDate>Mon, 1 Jan 2024 12:00:00 GMT</pubDate></item></channel></rss>""")
    (tmp_path / "b.atom").write_text("""<feed><entry><id>e1</id><title>Atom</title><summary>S</summary><link href="http://b/1"/><published>2024-01-16T00:00:00Z</published></entry></feed>""")
    reg = connectors.Registry()
    rss = reg.read(spark, "rss", str(tmp_path / "a.xml"), since=datetime(2024, 1, 2)).collect()
    assert [(r["source_id"], r["media_type"], r["body"]) for r in rss] == [("1", "AUDIO", "Body <b>x</b>")]
    atom = reg.read(spark, "arxiv", str(tmp_path / "b.atom")).first()
    assert (atom["source_id"], atom["url"], atom["published_at"]) == ("e1", "http://b/1", datetime(2024, 1, 16))
    (tmp_path / "r.json").write_text('{"data": {"children": [{"data": {"id": "x", "title": "T", "selftext": "S", "author": "A", "created_utc": 1705320000}}]}}')
    post = reg.read(spark, "reddit", str(tmp_path / "r.json")).first()
    assert (post["source_id"], post["title"], post["published_at"]) == ("x", "T", datetime(2024, 1, 15, 12))
    with pytest.raises(KeyError):
        reg.read(spark, "nowhere", "x")


def items(options):
    yield ("own", "1", "t", "b", None, None, "TEXT", datetime(2024, 1, 1))


def test_python_data_source(spark):
    spark.dataSource.register(connectors.ItemsSource)
    got = spark.read.format("heliograph_items").option("module", "tests.test_operators").option("function", "items").load().first()
    assert got["source_platform"] == "own"


def test_changelog(spark):
    text = "# Changes\n\n## [2.1.0] - 2024-01-15\n- a\n- b\n\n## 2.0.0\n- c\n"
    got = connectors.changelog_versions(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy("place").collect()
    assert [(r["version"], str(r["released"])) for r in got] == [("2.1.0", "2024-01-15"), ("2.0.0", "None")]


def test_strict_append_fails_on_known_key(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    sinks.append_new(df, str(tmp_path / "t"), ["k"], strict=True)
    with pytest.raises(ValueError):
        sinks.append_new(df, str(tmp_path / "t"), ["k"], strict=True)


def test_digests(spark):
    df = spark.createDataFrame([("T<", ["a&b", "c"])], "t string, i array<string>")
    assert df.select(sinks.digest_html(F.col("t"), F.col("i"))).first()[0] == "<h2>T&lt;</h2><ul><li>a&amp;b</li><li>c</li></ul>"
    assert df.select(sinks.digest_markdown(F.col("t"), F.col("i"))).first()[0] == "## T<\n\n- a&b\n- c\n"


def test_approximate_search_recall(spark):
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    data = [(i, [x + rnd.gauss(0, 0.6) for x in centres[i % 12]]) for i in range(1500)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["vec_id"]) for r in vectors.knn(df, q, 10).collect()}
    centroids, indexed = vectors.ivf_index(df)
    assert indexed.count() == 1500
    found = {(r["query_id"], r["vec_id"]) for r in vectors.ivf_search(centroids, indexed, q, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_table_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["vec_id"]) for r in vectors.knn(e, q, 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in vectors.ivf_search(*vectors.ivf_index(e), q, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_density_clusters_against_brute_force(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 8))
    x = np.vstack([centres[i % 6] + rnd.normal(size=8) * (0.1 + 0.12 * (i % 9)) for i in range(150)] + [np.zeros(8)])
    for eps in (0.05, 0.12, 0.5):
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        near = (1 - unit @ unit.T <= eps) | np.eye(len(x), dtype=bool)
        core, want = near.sum(1) >= 5, {}
        for root in np.flatnonzero(core):
            todo = [] if root in want else [root]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if j not in want:
                        want[j] = root
                        todo += [j] if core[j] else []
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        assert {r[0]: r[1] for r in vectors.density_clusters(df, eps, 5, block=40).collect()} == {int(a): int(b) for a, b in want.items()}


def test_trailing_counts_of_hot_keys_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", None]), rng.randrange(-500, 500)) for i in range(600)] + [(600, "hot", None), (601, "b", 7)]
    spans = {"short": 20, "long": 333}
    got = {r["id"]: (r["short"], r["long"]) for r in relational.trailing_counts(spark.createDataFrame(rows, "id int, k string, at long"), ["k"], "at", spans, 50).collect()}
    for i, k, at in rows:
        want = tuple(0 if at is None else sum(q == k and t is not None and at - s <= t <= at for _, q, t in rows) for s in spans.values())
        assert got[i] == want


def test_trailing_counts_of_no_rows(spark):
    df = spark.createDataFrame([], "k string, at long")
    assert relational.trailing_counts(df, ["k"], "at", {"n": 5}, 10).collect() == []


def test_bfs_over_more_rounds_than_are_kept_apart(spark):
    n = 2 * graphs.ROUNDS + 3
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 0), (2, 2)], "src int, dst int")
    got = {r["node"]: r["dist"] for r in graphs.bfs_distances(edges, spark.createDataFrame([(0,), (0,)], "node int")).collect()}
    assert got == {i: i for i in range(n + 1)}


def test_connector_filter_fills_in_columns_and_skips_what_does_not_fit(spark):
    at = datetime(2024, 1, 15, 12)
    rows = [("u", "p", "a", None, None, body, seen, at) for body, seen in [("first words " * 5, None), (None, "a caption that is long enough to be kept"), ("second " * 40, None), ("third words " * 3, "x"), ("short", None)]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, user_id string, platform string, author string, url string, title string, raw_text string, visual_text string, seen_at timestamp")
    got = {r["id"]: r["drop_stage"] for r in relational.connector_filter(df, ["id"], 150).collect()}
    assert got == {0: None, 1: None, 2: "char_budget", 3: None, 4: "min_text_length"}


def test_workflow_skips_fails_and_stops(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, x int")
    x = F.col("x")
    known = workflows.Registry()
    known.register("w", [workflows.Step("double", x * 2), workflows.Step("root", F.sqrt("double"), x != 5, F.when(x < 0, "negative")), workflows.Step("last", F.lit("done"))])
    got = {r["id"]: r for r in known.run("w", df).collect()}
    states = {i: [s["status"] for s in r["steps"]] for i, r in got.items()}
    assert states == {1: ["COMPLETED", "SKIPPED", "COMPLETED"], 2: ["COMPLETED", "FAILED"], 3: ["COMPLETED"] * 3}
    assert [(got[i]["status"], got[i]["error"], got[i]["last"]) for i in (1, 2, 3)] == [("COMPLETED", None, "done"), ("FAILED", "negative", None), ("COMPLETED", None, "done")]
    with pytest.raises(ValueError):
        known.register("w", [])


def test_page_and_range_checks():
    assert rules.page_bounds(3, 50) == (50, 100)
    for page, size in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            rules.page_bounds(page, size)
    assert rules.date_range(None, "2024-01-01T00:00:00Z")[0] is None
    assert rules.date_range("2024-01-01", "2024-01-01T00:00:00Z")
    for ends in (("2024-02-01", "2024-01-01"), ("soon", None)):
        with pytest.raises(ValueError):
            rules.date_range(*ends)


def test_sentiment_on_a_cut(spark):
    lexicon = {"a": 0.5, "b": 0.3, "c": -0.8, "d": 0.4, "f": -0.7}
    df = spark.createDataFrame([("a c d b",), ("A a f\nf",), ("b x x",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(rules.sentiment(F.col("text"), lexicon)).collect()] == ["positive", "negative", "neutral", "neutral", "neutral"]


def test_changed_pages_with_urls_that_come_twice(spark):
    pages = spark.createDataFrame([("u?1", "<p>a</p>"), ("u?1", "<p>b</p>"), ("v", "a"), ("v", "c"), ("w?", "a"), ("w?", "a")], "url string, html string")
    seen = pages.where("url <> 'v'").select("url", connectors.page_hash(F.col("html")).alias("hash"))
    now = pages.union(spark.createDataFrame([("u?1", "d"), ("n?", None)], "url string, html string"))
    got = sorted(r["url"] for r in connectors.changed_pages(now, seen).collect())
    assert got == ["n?", "u?1", "v", "v"]


def test_of_posts_seen_at_one_time_the_first_by_ties_is_kept(spark):
    t0 = datetime(2024, 1, 15, 12)
    rows = [(i, "u", "p", "a", None, None, f"{'x' * 64} text {i}", 0, False, t0) for i in (7, 3, 9, 1, 5)]
    df = spark.createDataFrame(rows, "id long, user_id string, platform string, author string, url string, title string, raw_text string, engagement int, is_trending boolean, seen_at timestamp")
    for order, first in (("id", 1), ("down", 9)):
        got = relational.acquisition_filter(df.withColumn("down", -F.col("id")), ties=[order]).where("drop_stage IS NULL").collect()
        assert [r["id"] for r in got] == [first]


def test_recommendations_are_asked_for_a_fiftieth_of_the_users(spark, sf):
    from heliograph.plans import registry

    got = registry.QUERIES["e14_als"](spark, sf).groupBy("user").agg(F.countDistinct("item").alias("n")).collect()
    users = spark.read.parquet(f"{sf}/orders.parquet").join(spark.read.parquet(f"{sf}/lineitem.parquet"), F.col("o_orderkey") == F.col("l_orderkey")).where("o_custkey % 50 = 0")
    assert {r["user"] for r in got} == {r[0] for r in users.select("o_custkey").distinct().collect()}
    assert all(r["n"] == 5 for r in got)


def test_every_user_gets_recommendations(spark, sf):
    from heliograph.plans import registry

    got = registry.QUERIES["e14_als"](spark, sf).groupBy("user").agg(F.count("*").alias("rows"), F.countDistinct("item").alias("n")).collect()
    users = spark.read.parquet(f"{sf}/orders.parquet").join(spark.read.parquet(f"{sf}/lineitem.parquet"), F.col("o_orderkey") == F.col("l_orderkey"))
    assert {r["user"] for r in got} == {r[0] for r in users.select("o_custkey").distinct().collect()}
    assert all(r["n"] == r["rows"] == 5 for r in got)


@pytest.mark.parametrize("head", [3, 40, 1000])
def test_largest_inner_products_are_exact(spark, head):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) * (1 + i % 7) for _ in range(5)]) for i in range(300)]
    rows += [(1000 + i, v) for i, v in rows[:60]] + [(2000, [0.0] * 5), (2001, [0.0] * 5)]
    asked = [(i, [rnd.gauss(0.5, 1) for _ in range(5)]) for i in range(90)] + [(90, [0.0] * 5), (91, [-9.0] * 5)]
    df = spark.createDataFrame(rows, "id long, features array<float>")
    queries = spark.createDataFrame(asked, "query_id long, features array<float>")
    out = vectors.best_products(df, queries, 4, head=head, part_rows=50, block=25)
    items, want, got = {r["id"]: r["features"] for r in df.collect()}, {}, {}
    for q in queries.collect():
        want[q["query_id"]] = sorted((-reduce(lambda s, x: s + x[0] * x[1], zip(q["features"], v, strict=True), 0.0), i) for i, v in items.items())[:4]
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    assert got == want


def test_scores_of_texts_are_counted_in_the_row(spark):
    words = "a b c a b d".split()
    rnd = random.Random(3)
    rows = [(i, [rnd.choice(words) for _ in range(rnd.randrange(9))], [rnd.choice(words) for _ in range(rnd.randrange(9))]) for i in range(600)] + [(600, None, ["a"]), (601, [], [])]
    df = spark.createDataFrame(rows, "id long, g array<string>, t array<string>").coalesce(1)
    found = evaluation.overlaps(df, ["id"], "g", "t", (1, 2))
    assert "Exchange" not in evaluation.rouge(df, ["id"], "g", "t")._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        g, t = (x or [] for x in rows[r["id"]][1:])
        for n in (1, 2):
            a, b = ([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (g, t))
            assert (r[f"guessed{n}"], r[f"true{n}"], r[f"hit{n}"]) == (len(a), len(b), sum(min(a.count(x), b.count(x)) for x in set(a)))


def test_nearest_rank_of_one_large_group(spark):
    rnd = random.Random(5)
    rows = [("a", float(rnd.randrange(3000))) for _ in range(20_000)] + [("b", 1.0)] * 7 + [(None, float(i)) for i in range(10)] + [("n", None)] * 3 + [("a", None), ("i", float("inf")), ("i", -1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = relational.nearest_rank(df, ["k"], "v", [1, 50, 95, 100])
    got = {r["k"]: tuple(r)[1:] for r in out.collect()}
    for k in {r[0] for r in rows}:
        vs = sorted(v for key, v in rows if key == k and v is not None)
        assert got[k] == tuple(vs[max(math.ceil(p / 100 * len(vs)), 1) - 1] if vs else None for p in (1, 50, 95, 100))
    # the large group's values aren't sorted by one task
    assert "percentile_disc" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_frequent_words_are_counted_in_the_row(spark):
    df = spark.createDataFrame([(1, "bbb aaa the aaa cc ccc ccc bbb ddd"), (2, None), (3, "")], "id long, low string")
    out = relational.frequent_words(df, "low", "words", 2, 3, ["the"])
    assert {r["id"]: r["words"] for r in out.collect()} == {1: "aaa,bbb", 2: None, 3: ""}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_connector_filter_moves_no_texts(spark, sf):
    from heliograph.plans import registry

    rows = [(i, "u", "p", f"{i % 40} {'long text ' * (i % 50)}", datetime(2024, 1, 15, 12) + timedelta(minutes=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, user_id string, platform string, raw_text string, seen_at timestamp").selectExpr("*", "CAST(NULL AS string) author", "CAST(NULL AS string) url", "CAST(NULL AS string) title")
    whole = relational.connector_filter(df, ["id"], 9000)
    few = relational.connector_filter(df, ["id"], 9000, keep=["id"])
    assert few.columns == ["id", "drop_stage"] and "raw_text" in whole.columns
    assert sorted(map(tuple, few.collect())) == sorted((r["id"], r["drop_stage"]) for r in whole.collect())
    for name in ("flt06_connector_filter", "flt04_acquisition_filter"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "MapInArrow" in line and "raw_text" in line]
