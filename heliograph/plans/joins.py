"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import relational, vectors
from .registry import SIGNALS, query, signals, table


@query("j01_inference_observation", "SELECT l.l_orderkey AS id, l.l_linenumber AS line, o.o_orderstatus AS status FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def inference_observation(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("o_orderstatus").alias("status"))


@query("j02_anti_new", "SELECT DISTINCT c_custkey AS user_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_new(spark, d):
    return relational.anti_new(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")), ["user_id"])


@query("j03_watched_entities", "SELECT DISTINCT e.user_id, e.event_type FROM events e WHERE e.user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def watched_entities(spark, d):
    watched = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").select("user_id", "event_type").join(watched, "user_id", "left_semi").distinct()


KB = "(VALUES ('automobile', 'Q1', 'Automobile'), ('building', 'Q2', 'Building'), ('furniture', 'Q3', 'Furniture')) AS kb(surface, canonical_id, name)"


@query("j04_kb_link", f"SELECT c_custkey AS id, canonical_id, name FROM customer LEFT JOIN {KB} ON lower(c_mktsegment) = surface")
def kb_link(spark, d):
    kb = spark.sql(f"SELECT * FROM {KB}")
    return table(spark, d, "customer").join(F.broadcast(kb), F.lower("c_mktsegment") == F.col("surface"), "left").select(F.col("c_custkey").alias("id"), "canonical_id", "name")


TERMS = [("the", "The"), ("license", "License"), ("token", "Token"), ("password", "Credential"), ("secret", "Credential")]


@query("j05_kb_expansion", f"""WITH kb(pos, surface, name) AS (VALUES {", ".join(f"({i}, '{s}', '{n}')" for i, (s, n) in enumerate(TERMS))}),
hit AS (SELECT doc_id, name, min(pos) AS pos FROM documents, kb WHERE contains(lower(text), surface) GROUP BY doc_id, name)
SELECT d.doc_id, coalesce(string_agg(name, ',' ORDER BY pos), '') AS terms FROM documents d LEFT JOIN (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 3) h ON d.doc_id = h.doc_id GROUP BY d.doc_id""")
def kb_expansion(spark, d):
    """The dictionary is a fixed, small list, so that it is looked up within the row."""
    kb = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")) for s, n in TERMS))
    hits = F.transform(F.filter(kb, lambda k: F.contains(F.lower("text"), k["s"])), lambda k: k["n"])
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", F.slice(F.array_distinct(hits), 1, 3)).alias("terms"))


@query("j06_alias_resolution", """WITH names AS (SELECT DISTINCT p_name FROM part), alias(surface, canonical) AS (VALUES ('small ring', 'ring-s'), ('red widget', 'widget-r'), ('blue bolt', 'bolt-b'))
SELECT p_partkey AS id, coalesce(a.canonical, b.canonical) AS canonical FROM part LEFT JOIN alias a ON p_name = a.surface LEFT JOIN alias b ON regexp_replace(lower(p_name), '[^a-z ]', '', 'g') = b.surface""")
def alias_resolution(spark, d):
    alias = spark.sql("SELECT * FROM (VALUES ('small ring', 'ring-s'), ('red widget', 'widget-r'), ('blue bolt', 'bolt-b')) AS alias(surface, canonical)")
    exact, loose = (F.broadcast(alias.select(F.col("surface").alias(f"s{i}"), F.col("canonical").alias(f"c{i}"))) for i in (1, 2))
    p = table(spark, d, "part")
    return p.join(exact, F.col("p_name") == F.col("s1"), "left").join(loose, F.regexp_replace(F.lower("p_name"), "[^a-z ]", "") == F.col("s2"), "left").select(F.col("p_partkey").alias("id"), F.coalesce("c1", "c2").alias("canonical"))


CANON = ["small rings", "red widgets", "blue bolts", "green gear", "large nut"]


@query("j07_fuzzy_alias", f"""WITH canon(pos, name) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(CANON))}), names AS (SELECT DISTINCT p_name FROM part),
best AS (SELECT p_name, name, levenshtein(p_name, name) AS dist FROM names, canon WHERE levenshtein(p_name, name) <= 2 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY levenshtein(p_name, name), pos) = 1)
SELECT p_partkey AS id, name AS canonical, dist FROM part JOIN best USING (p_name)""")
def fuzzy_alias(spark, d):
    """Distances are made for distinct names only; canonical names are a fixed list within the row."""
    canon = F.array(*map(F.lit, CANON))
    names = table(spark, d, "part").select("p_name").distinct()
    tried = F.transform(canon, lambda c, i: F.struct(F.levenshtein("p_name", c).cast("long").alias("dist"), i.alias("pos"), c.alias("name")))
    best = names.select("p_name", F.array_min(F.filter(tried, lambda t: t["dist"] <= 2)).alias("best")).where("best IS NOT NULL")
    return table(spark, d, "part").join(best, "p_name").select(F.col("p_partkey").alias("id"), F.col("best.name").alias("canonical"), F.col("best.dist").alias("dist"))


KNN_SQL = """SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 4) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS INTEGER) AS rank
 FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY rank <= {k}"""


def nearest(spark, d, k):
    e = table(spark, d, "embeddings")
    found = vectors.knn(e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), k)
    return found.withColumn("similarity", F.round("similarity", 4))


@query("j08_knn_cosine", KNN_SQL.format(k=10))
def knn_cosine(spark, d):
    return nearest(spark, d, 10)


@query("j10_vector_order", KNN_SQL.format(k=5))
def vector_order(spark, d):
    return nearest(spark, d, 5)


@query("j11_vector_search_by_label", """SELECT query_id, vec_id, similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 4) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS n
 FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.label = 1) WHERE n <= 5""")
def vector_search_by_label(spark, d):
    e = table(spark, d, "embeddings")
    found = vectors.knn(e.where("label = 1"), e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 5)
    return found.select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"))


@query("j16_point_in_interval", """WITH band(pos, low, high, topic) AS (VALUES (0, 0.0, 3.0, 'low'), (1, 2.5, 10.0, 'middle'), (2, 9.0, 1000.0, 'high'))
SELECT event_id, topic FROM (SELECT event_id, topic, row_number() OVER (PARTITION BY event_id ORDER BY pos) AS n FROM events LEFT JOIN band ON value BETWEEN low AND high) WHERE n = 1""")
def point_in_interval(spark, d):
    bands = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(t).alias("topic")) for a, b, t in ((0.0, 3.0, "low"), (2.5, 10.0, "middle"), (9.0, 1000.0, "high"))))
    return table(spark, d, "events").select("event_id", F.get(F.filter(bands, lambda b: F.col("value").between(b["low"], b["high"])), F.lit(0))["topic"].alias("topic"))


@query("j17_interval_overlap", """SELECT a.conv_id, a.turn, CAST(count(b.turn) AS BIGINT) AS overlapping, string_agg(b.role, ',' ORDER BY b.turn) AS roles, arg_min(b.role, b.turn) AS first_speaker FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn + 1 AND b.turn + 1 >= a.turn GROUP BY a.conv_id, a.turn""")
def interval_overlap(spark, d):
    """Intervals [turn, turn + 1] of one conversation that touch; the band is a range frame, not a join."""
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-1, 1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("overlapping"), F.concat_ws(",", F.collect_list("role").over(w)).alias("roles"), F.first("role").over(w).alias("first_speaker"))


@query("j19_temporal_follows", """SELECT a.o_orderkey AS earlier, b.o_orderkey AS later FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 90 DAY""")
def temporal_follows(spark, d):
    """Follow edges reach 90 days, so that both sides meet in buckets of that width and a long history isn't squared."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.floor(F.unix_seconds("o_orderdate") / (90 * 86400)).alias("b"))
    early = o.select(F.col("o_orderkey").alias("earlier"), "o_custkey", F.col("o_orderdate").alias("t1"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    late = o.select(F.col("o_orderkey").alias("later"), "o_custkey", F.col("o_orderdate").alias("t2"), "b")
    return early.join(late, ["o_custkey", "b"]).where("t1 < t2 AND t2 <= t1 + INTERVAL 90 DAY").select("earlier", "later")


@query("j20_weighted_neighbours", """WITH e AS (SELECT o_custkey, l_partkey, sum(l_quantity) * max(p_retailprice) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT o_custkey AS src, l_partkey AS dst, round(w, 4) AS weight FROM e QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, l_partkey) <= 5""")
def weighted_neighbours(spark, d):
    edges = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("ew"))
    scored = edges.join(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("p_partkey") == F.col("l_partkey")).withColumn("w", F.col("ew") * F.col("p_retailprice"))
    return relational.top_per_group(scored, ["o_custkey"], [F.desc("w"), F.col("l_partkey")], 5).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.round("w", 4).alias("weight"))


@query("j21_entity_sources", "SELECT lang AS entity, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang")
def entity_sources(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("entity")).agg(F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"))


@query("j22_dependency_alerts", """WITH watch(brand, pinned) AS (VALUES ('Brand#1', 10), ('Brand#2', 20), ('Brand#3', 30)) SELECT p_partkey AS id, CASE WHEN p_name LIKE '%bolt%' THEN 'critical' WHEN p_size - pinned >= 10 THEN 'high' WHEN p_size > pinned THEN 'medium' ELSE 'low' END AS impact
 FROM part JOIN watch ON brand = p_brand WHERE p_size <> pinned""")
def dependency_alerts(spark, d):
    watch = spark.sql("SELECT * FROM (VALUES ('Brand#1', 10), ('Brand#2', 20), ('Brand#3', 30)) AS watch(brand, pinned)")
    impact = F.when(F.col("p_name").like("%bolt%"), "critical").when(F.col("p_size") - F.col("pinned") >= 10, "high").when(F.col("p_size") > F.col("pinned"), "medium").otherwise("low")
    return table(spark, d, "part").join(F.broadcast(watch), F.col("brand") == F.col("p_brand")).where("p_size <> pinned").select(F.col("p_partkey").alias("id"), impact.alias("impact"))


@query("j23_watchlist_boost", """WITH node(topic, priority) AS (VALUES ('en', 0.9), ('src0', 0.5), ('src1', 0.7)) SELECT doc_id, round(avg(priority), 6) AS boost FROM (SELECT doc_id, unnest([lang, source]) AS topic FROM documents) JOIN node USING (topic) GROUP BY doc_id""")
def watchlist_boost(spark, d):
    node = spark.sql("SELECT topic, CAST(priority AS DOUBLE) AS priority FROM (VALUES ('en', 0.9), ('src0', 0.5), ('src1', 0.7)) AS node(topic, priority)")
    each = table(spark, d, "documents").select("doc_id", F.explode(F.array("lang", "source")).alias("topic"))
    return each.join(F.broadcast(node), "topic").groupBy("doc_id").agg(F.round(F.avg("priority"), 6).alias("boost"))


@query("j24_watched_candidates", "SELECT n_name AS entity, CAST(count(c_custkey) AS BIGINT) AS candidates, round(max(c_acctbal), 2) AS best FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name")
def watched_candidates(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 9000")
    return table(spark, d, "nation").join(rich, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("entity")).agg(F.count("c_custkey").alias("candidates"), F.round(F.max("c_acctbal"), 2).alias("best"))


@query("j25_feedback_delta", f"SELECT s.id, coalesce(f.delta, 0.0) AS delta FROM ({SIGNALS}) s LEFT JOIN (SELECT user_id, round(avg(value), 4) AS delta FROM events WHERE event_type = 'click' GROUP BY user_id) f ON f.user_id = s.user_id")
def feedback_delta(spark, d):
    f = table(spark, d, "events").where("event_type = 'click'").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("delta"))
    return signals(spark, d).join(f, "user_id", "left").select("id", F.coalesce("delta", F.lit(0.0)).alias("delta"))


@query("j26_ranked_originals", "SELECT l.doc_id, d.lang, l.quality FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def ranked_originals(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "left").select("doc_id", "lang", "quality")


@query("j27_citation_check", "SELECT CAST(count(*) AS BIGINT) AS missing FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) AND l.toxic = 0")
def citation_check(spark, d):
    return table(spark, d, "labels").where("toxic = 0").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("missing"))


@query("j28_registry_lookup", "SELECT e.event_id, coalesce(c.c_mktsegment, 'UNKNOWN') AS family FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def registry_lookup(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return table(spark, d, "events").join(c, "user_id", "left").select("event_id", F.coalesce("c_mktsegment", F.lit("UNKNOWN")).alias("family"))


TOK = "list_distinct([w FOR w IN regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+') IF w <> '' AND length(w) > 2])"


TITLE_SQL = f"SELECT doc_id, n_chars AS trust, {TOK.format("regexp_extract(text, '^(?:\\S+\\s+){0,11}\\S*')")} AS toks FROM documents"
PAIRS_SQL = f"""WITH t AS ({TITLE_SQL}), u AS (SELECT toks, count(*) AS copies, max_by(doc_id, (trust, -doc_id)) AS doc_id, max(trust) AS trust FROM (SELECT doc_id, trust, list_sort(toks) AS toks FROM t WHERE len(toks) > 0) GROUP BY toks),
x AS (SELECT doc_id, trust, unnest(toks) AS tok, len(toks) AS n FROM u),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, max(a.trust) AS ta, max(b.trust) AS tb, count(*) / (max(a.n) + max(b.n) - count(*)) AS similarity FROM x a JOIN x b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) / (max(a.n) + max(b.n) - count(*)) >= 0.7)"""


def titles(spark, d):
    """doc_id, trust and the sorted distinct tokens of each title; a text's first twelve words stand for one."""
    tokens = F.array_sort(F.filter(text.words(F.regexp_extract("text", r"^(?:\S+\s+){0,11}\S*", 0)), lambda w: F.length(w) > 2))
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("trust"), tokens.alias("tokens"))


def title_classes(docs):
    """Distinct titles, each with its most trusted document (the longest, of equals the first)."""
    return docs.where(F.size("tokens") > 0).groupBy("tokens").agg(F.max_by("doc_id", F.struct("trust", -F.col("doc_id"))).alias("doc_id"), F.max("trust").alias("trust"), F.count("*").alias("copies"))


@query("j12_similar_titles", rf"{PAIRS_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM p")
def similar_titles(spark, d):
    """Pairs of distinct titles with similarity .70 or more. They meet where they share three of the rarest tokens of each and are measured there: with similarity s, any n - ceil(s n) + 3 of n tokens hold three shared ones."""
    from ..operators.setjoin import set_similarity_join

    return set_similarity_join(title_classes(titles(spark, d)), "doc_id", "tokens", 0.7).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("j13_similar_sources", rf"{PAIRS_SQL} SELECT CASE WHEN tb > ta THEN a ELSE b END AS dropped FROM p UNION SELECT t.doc_id FROM t JOIN u ON list_sort(t.toks) = u.toks WHERE t.doc_id <> u.doc_id")
def similar_sources(spark, d):
    """Documents that lose to a more trusted one (of equals, the first) with a title of similarity .70 or more; the equal ones in one aggregate, all without pairs."""
    from ..operators.setjoin import outranked
    from ..operators.state import written

    docs = written(titles(spark, d), "titles")
    classes = title_classes(docs)
    lost = outranked(classes, "doc_id", "tokens", 0.7, "trust").select(F.col("doc_id").alias("dropped"))
    copies = docs.select(F.col("doc_id").alias("id"), "tokens").join(classes.where("copies > 1").select("tokens", "doc_id"), "tokens").where("id <> doc_id").select(F.col("id").alias("dropped"))
    return lost.union(copies).distinct()


def neighbour_index(spark, d, **options):
    """The graph index over all embeddings, saved in the shared folder and loaded from there."""
    import uuid

    from ..operators.neighbours import NeighbourGraph
    from ..operators.state import shared_dir

    return NeighbourGraph.build(table(spark, d, "embeddings"), **options).save(f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}")


@query("j09_approximate_knn")
def approximate_knn(spark, d):
    """The ten nearest rows by the graph index; tests hold its recall against exact search."""
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return neighbour_index(spark, d).search(asked, 10).select("query_id", "vec_id", "rank")


@query("snk12_graph_index")
def graph_index(spark, d):
    """A saved and loaded index, searched with a predicate on a stored column: the ten nearest rows with labels below 5."""
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = neighbour_index(spark, d, keep=["label"]).search(asked, 10, where=F.col("label") < 5)
    return found.select("query_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


@query("j14_claim_pairs", r"""WITH c AS (SELECT conv_id, turn, regexp_matches(lower(text), '(^|\s)(not|no|pas|nicht)(\s|$)') AS neg, list_distinct([w FOR w IN regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+') IF length(w) >= 3]) AS ws FROM conversations)
SELECT a.conv_id, a.turn AS first, b.turn AS second FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.neg <> b.neg WHERE len(list_intersect(a.ws, b.ws)) >= 2""")
def claim_pairs(spark, d):
    """Pairs i < j of one conversation's turns, one negated, that share two words or more; only opposite ones meet."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lower("text").rlike(r"(^|\s)(not|no|pas|nicht)(\s|$)").alias("neg"), F.filter(text.words(F.col("text")), lambda x: F.length(x) >= 3).alias("ws"))
    yes, no = c.where("neg").toDF("conv_id", "t1", "n1", "w1"), c.where("NOT neg").toDF("conv_id", "t2", "n2", "w2")
    return yes.join(no, "conv_id").where("size(array_intersect(w1, w2)) >= 2").select("conv_id", F.least("t1", "t2").alias("first"), F.greatest("t1", "t2").alias("second"))


@query("j15_source_attribution", rf"""WITH t AS (SELECT conv_id, turn, role, {TOK.format("text")} AS ws FROM conversations), p AS (SELECT q.conv_id, q.turn, s.turn AS source, CASE WHEN len(q.ws) = 0 THEN 0 ELSE len(list_intersect(q.ws, s.ws)) / len(q.ws) END AS recall FROM t q JOIN t s ON q.conv_id = s.conv_id AND q.role = 'assistant' AND s.role <> 'assistant')
SELECT conv_id, turn, source, round(recall, 6) AS recall FROM p WHERE recall >= 0.1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY recall DESC, source) <= 10""")
def source_attribution(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.filter(text.words(F.col("text")), lambda w: F.length(w) > 2).alias("ws"))
    q = t.where("role = 'assistant'").select("conv_id", "turn", F.col("ws").alias("qs"))
    s = t.where("role <> 'assistant'").select("conv_id", F.col("turn").alias("source"), F.col("ws").alias("ss"))
    p = q.join(s, "conv_id").select("conv_id", "turn", "source", text.recall(F.col("qs"), F.col("ss")).alias("recall")).where("recall >= 0.1")
    return relational.top_per_group(p, ["conv_id", "turn"], [F.desc("recall"), F.col("source")], 10).select("conv_id", "turn", "source", F.round("recall", 6).alias("recall"))


@query("j18_midpoint_turn", """WITH t AS (SELECT conv_id, turn, role, coalesce(sum(n) OVER w, 0) - n AS a, sum(n) OVER w AS b FROM (SELECT *, coalesce(length(text), 0) AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, CAST(i // 200 AS BIGINT) AS segment, (i + least(i + 200, total)) / 2 AS mid FROM (SELECT conv_id, total, unnest(range(0, total, 200)) AS i FROM (SELECT conv_id, CAST(max(b) AS BIGINT) AS total FROM t GROUP BY conv_id)))
SELECT s.conv_id, segment, arg_min(t.role, t.turn) AS speaker FROM s JOIN t ON t.conv_id = s.conv_id AND mid BETWEEN a AND b GROUP BY s.conv_id, segment""")
def midpoint_turn(spark, d):
    """Who speaks at the midpoint of each 200-character segment of a conversation, whose turns follow each other.

    Turns and midpoints meet in one ordered pass a conversation. A midpoint on a border belongs to the turn before.
    """
    ordered = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    turns = turns.withColumn("b", F.sum("n").over(ordered))
    total = turns.groupBy("conv_id").agg(F.max("b").alias("total")).where("total > 0")
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(200).cast("long")))
    segments = total.select("conv_id", "total", i.alias("i")).select("conv_id", F.expr("i div 200").alias("segment"), ((F.col("i") + F.least(F.col("i") + 200, F.col("total"))) / 2).alias("at"))
    starts = turns.select("conv_id", (F.col("b") - F.col("n")).cast("double").alias("at"), "turn", "role")
    both = starts.unionByName(segments, allowMissingColumns=True)
    so_far = Window.partitionBy("conv_id").orderBy("at", F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    named = both.withColumn("speaker", F.last(F.when(F.col("turn").isNotNull(), F.struct("role")), ignorenulls=True).over(so_far)["role"])
    return named.where("segment IS NOT NULL").select("conv_id", "segment", "speaker")
