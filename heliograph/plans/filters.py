"""Filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational
from .registry import SIGNALS, query, signals, table


@query("flt01_search", "SELECT o_orderkey AS id, o_orderpriority AS platform, o_orderdate AS at FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1996-01-01'")
def search(spark, d):
    o = table(spark, d, "orders")
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"))).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("platform"), F.col("o_orderdate").alias("at"))


@query("flt02_signal_queue", f"SELECT id, status, action_score FROM ({SIGNALS}) WHERE signal_type IN ('1-URGENT', '3-MEDIUM') AND action_score BETWEEN 0.2 AND 0.9 AND status IN ('NEW', 'QUEUED', 'IN_PROGRESS')")
def signal_queue(spark, d):
    s = signals(spark, d)
    return s.where(F.col("signal_type").isin("1-URGENT", "3-MEDIUM") & F.col("action_score").between(0.2, 0.9) & F.col("status").isin("NEW", "QUEUED", "IN_PROGRESS")).select("id", "status", "action_score")


@query("flt03_digest_fetch", """SELECT doc_id, source, lang FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4') AND list_has_any([lang, source], ['en', 'src3']) ORDER BY doc_id DESC LIMIT 1000""")
def digest_fetch(spark, d):
    docs = table(spark, d, "documents")
    topics = F.array("lang", "source")
    return relational.page(docs.where(F.col("source").isin("src0", "src1", "src2", "src3", "src4") & F.arrays_overlap(topics, F.array(F.lit("en"), F.lit("src3")))).select("doc_id", "source", "lang"), [F.desc("doc_id")], 1000)


@query("flt04_acquisition_filter", r"""WITH p AS (SELECT doc_id, source, text AS body, CASE WHEN source = 'src9' THEN 'platform_gate' WHEN contains(lower(text), 'thing') THEN 'keyword_blocklist' END AS early, lang, source FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY lang, fp, early IS NULL ORDER BY 1) AS n FROM (SELECT p.*, sha1(source || '||' || substr(body, 1, 64)) AS fp FROM p))
SELECT drop_stage, count(*) AS n FROM (SELECT CASE WHEN early IS NOT NULL THEN early WHEN n > 1 THEN 'deduplication'
 WHEN length(regexp_replace(body, '[^\p{Lu}]', '', 'g')) >= 0.7 * length(regexp_replace(body, '[^\p{L}]', '', 'g')) AND length(regexp_replace(body, '[^\p{L}]', '', 'g')) > 0 THEN 'bot_detection' WHEN length(body) < 20 THEN 'min_text_length' END AS drop_stage FROM q) GROUP BY drop_stage""")
def acquisition_filter(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("user_id"), F.col("source").alias("platform"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("title"),
        F.col("text").alias("raw_text"), F.lit(0).alias("engagement"), F.lit(False).alias("is_trending"), F.lit("2024-01-15 12:00:00").cast("timestamp").alias("seen_at"),
    )
    kept = relational.acquisition_filter(docs, platforms=[f"src{i}" for i in range(20) if i != 9], block=["thing"], ties=["doc_id"], keep=["doc_id"])
    return kept.groupBy("drop_stage").agg(F.count("*").alias("n"))


@query("flt07_bot_heuristic", r"""SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE round(u / n, 6) END AS caps, (n > 0 AND u / n >= 0.7) OR (length(text) > 0 AND (length(text) - length(regexp_replace(text, 'https?://\S+', '', 'g')) > 0) AND len(regexp_extract_all(text, 'https?://\S+')) / (length(text) / 100) >= 3) AS bot
 FROM (SELECT doc_id, text, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS u, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n FROM documents)""")
def bot_heuristic(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.caps_ratio(F.col("text")), 6).alias("caps"), text.likely_bot(F.col("text")).alias("bot"))


@query("flt08_validation", r"""SELECT page_id, url IS NOT NULL AND url <> '' AND regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS valid, CASE WHEN url IS NULL OR url = '' THEN 'missing' WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN 'bad_url' END AS reject FROM pages""")
def validation(spark, d):
    url = F.col("url")
    missing, bad = url.isNull() | (url == ""), ~url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")
    return table(spark, d, "pages").select("page_id", (~missing & ~bad).alias("valid"), F.when(missing, "missing").when(bad, "bad_url").alias("reject"))


@query("flt09_pii_clean", r"SELECT doc_id, NOT regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS clean FROM documents")
def pii_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", (~F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).alias("clean"))


@query("flt10_timeline", "SELECT event_id, user_id FROM events WHERE (ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') AND list_contains([event_type], 'click')")
def timeline(spark, d):
    at = F.col("ts")
    inside = at.isNull() | at.between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return table(spark, d, "events").where(inside & F.array_contains(F.array("event_type"), "click")).select("event_id", "user_id")


@query("flt11_audit_query", "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' AND value >= 5 AND ts >= TIMESTAMP '2024-01-02' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_query(spark, d):
    e = table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("value") >= 5) & (F.col("ts") >= F.lit("2024-01-02").cast("timestamp")))
    return relational.page(e, [F.desc("ts"), F.desc("event_id")], 100).select("event_id", "event_type", "value")


POLICY = "(VALUES ('1-URGENT', 100), ('2-HIGH', 400)) AS policy(cls, days)"


@query("flt12_retention_check", f"SELECT o_orderkey AS id, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') > coalesce(days, 365) AS expired FROM orders LEFT JOIN {POLICY} ON cls = o_orderpriority")
def retention_check(spark, d):
    policy = spark.sql(f"SELECT * FROM {POLICY}")
    age = F.expr("datediff(TIMESTAMP '2000-01-01', o_orderdate)")
    return table(spark, d, "orders").join(F.broadcast(policy), F.col("cls") == F.col("o_orderpriority"), "left").select(F.col("o_orderkey").alias("id"), (age > F.coalesce("days", F.lit(365))).alias("expired"))


@query("flt13_purge_eligible", f"SELECT o_orderpriority AS cls, count(*) AS records, CAST(count(*) FILTER (date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') > coalesce(days, 365) AND o_orderstatus <> 'P') AS BIGINT) AS purgeable FROM orders LEFT JOIN {POLICY} ON cls = o_orderpriority GROUP BY o_orderpriority")
def purge_eligible(spark, d):
    policy = spark.sql(f"SELECT * FROM {POLICY}")
    o = table(spark, d, "orders").join(F.broadcast(policy), F.col("cls") == F.col("o_orderpriority"), "left")
    over = (F.expr("datediff(TIMESTAMP '2000-01-01', o_orderdate)") > F.coalesce("days", F.lit(365))) & (F.col("o_orderstatus") != "P")
    return o.groupBy(F.col("o_orderpriority").alias("cls")).agg(F.count("*").alias("records"), F.count_if(over).alias("purgeable"))


@query("flt14_quality_gate", f"SELECT id, action_score >= 0.5 AS passed, CASE WHEN action_score >= 0.5 THEN 'published' ELSE 'rejected' END AS gate FROM ({SIGNALS})")
def quality_gate(spark, d):
    ok = F.col("action_score") >= 0.5
    return signals(spark, d).select("id", ok.alias("passed"), F.when(ok, "published").otherwise("rejected").alias("gate"))


@query("flt16_abstention", """SELECT event_id, CASE WHEN value / 20 < 0.7 AND value < 2 THEN 'LOW_CONFIDENCE' WHEN user_id % 7 = 0 THEN 'DISAGREEMENT' WHEN value < 4 THEN 'INCOMPLETE' WHEN value < 5 THEN 'LOW_QUALITY' WHEN event_type = 'error' THEN 'OUT_OF_SCOPE' END AS reason FROM events""")
def abstention(spark, d):
    v = F.col("value")
    reason = F.when((v / 20 < 0.7) & (v < 2), "LOW_CONFIDENCE").when(F.col("user_id") % 7 == 0, "DISAGREEMENT").when(v < 4, "INCOMPLETE").when(v < 5, "LOW_QUALITY").when(F.col("event_type") == "error", "OUT_OF_SCOPE")
    return table(spark, d, "events").select("event_id", reason.alias("reason"))


@query("flt17_candidate_pruning", f"""WITH s AS ({SIGNALS}), h AS (SELECT DISTINCT user_id FROM s WHERE status = 'ACTED'), k AS (SELECT s.*, h.user_id IS NOT NULL OR action_score >= 0.6 AS keep, max(action_score) OVER (PARTITION BY s.user_id) AS best FROM s LEFT JOIN h USING (user_id))
SELECT id, user_id FROM (SELECT *, max(keep) OVER (PARTITION BY user_id) AS held FROM k) WHERE keep OR (NOT held AND action_score = best)""")
def candidate_pruning(spark, d):
    from pyspark.sql.window import Window

    s, w = signals(spark, d), Window.partitionBy("user_id")
    keep = F.max(F.col("status") == "ACTED").over(w) | (F.col("action_score") >= 0.6)
    marked = s.withColumns({"keep": keep, "best": F.max("action_score").over(w)}).withColumn("held", F.max("keep").over(w))
    return marked.where(F.col("keep") | (~F.col("held") & (F.col("action_score") == F.col("best")))).select("id", "user_id")


@query("flt18_reasoning_mode", f"""SELECT user_id, CASE WHEN sum(n) > 6 THEN 'chain_of_thought' WHEN max(action_score) - min(action_score) < 0.1 THEN 'multi_agent' WHEN max(action_score) > 0.85 THEN 'single_call' ELSE 'few_shot' END AS mode FROM (SELECT *, 1 AS n FROM ({SIGNALS})) GROUP BY user_id""")
def reasoning_mode(spark, d):
    top, low = F.max("action_score"), F.min("action_score")
    return signals(spark, d).groupBy("user_id").agg(F.when(F.count("*") > 6, "chain_of_thought").when(top - low < 0.1, "multi_agent").when(top > 0.85, "single_call").otherwise("few_shot").alias("mode"))


@query("flt19_training_admission", r"SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND n_chars >= 50 AND NOT regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def training_admission(spark, d):
    docs = table(spark, d, "documents").where((F.col("n_chars") >= 50) & ~F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).select("doc_id")
    return docs.join(table(spark, d, "labels").where("quality = 1 AND toxic = 0"), "doc_id").select("doc_id")


@query("flt20_policy_checks", """SELECT doc_id, array_to_string([p FOR p IN ['guarantee', 'password', 'free', 'license'] IF contains(lower(text), p)], ',') AS violations FROM documents""")
def policy_checks(spark, d):
    words = F.array(*map(F.lit, ("guarantee", "password", "free", "license")))
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", F.filter(words, lambda p: F.contains(F.lower("text"), p))).alias("violations"))


@query("flt21_source_eligibility", """SELECT source, failures < 30 AND trust >= 0.4 AS eligible FROM (SELECT source, count(*) FILTER (n_chars < 200) AS failures, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.3 END) AS trust FROM documents GROUP BY source)""")
def source_eligibility(spark, d):
    state = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") < 200).alias("failures"), F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.3)).alias("trust"))
    return state.select("source", ((F.col("failures") < 30) & (F.col("trust") >= 0.4)).alias("eligible"))


@query("flt22_family_routing", """SELECT doc_id, CASE WHEN n_chars > 10000 THEN 'paper' WHEN source IN ('src1', 'src2') THEN 'devintel' WHEN lang = 'fr' THEN 'audio' ELSE 'social' END AS family FROM documents""")
def family_routing(spark, d):
    family = F.when(F.col("n_chars") > 10000, "paper").when(F.col("source").isin("src1", "src2"), "devintel").when(F.col("lang") == "fr", "audio").otherwise("social")
    return table(spark, d, "documents").select("doc_id", family.alias("family"))


@query("flt23_relevance_keywords", """SELECT doc_id, round(tanh((CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(text), 'token') THEN 2.0 ELSE 0 END) / 2.1), 4) AS relevance FROM documents""")
def relevance_keywords(spark, d):
    has = lambda w, x: F.when(F.contains(F.lower("text"), F.lit(w)), x).otherwise(0.0)
    return table(spark, d, "documents").select("doc_id", F.round(F.tanh((has("the", 1.0) + has("license", 1.5) + has("token", 2.0)) / 2.1), 4).alias("relevance"))


@query("prj01_summary", f"SELECT id, user_id, status, signal_type, round(action_score, 4) AS score FROM ({SIGNALS})")
def summary(spark, d):
    return signals(spark, d).select("id", "user_id", "status", "signal_type", F.round("action_score", 4).alias("score"))


@query("prj02_item_to_observation", "SELECT 'documents:' || doc_id AS id, source AS source_platform, CAST(doc_id AS VARCHAR) AS source_id, coalesce(nullif(text, ''), '') AS raw_text, lang, 'TEXT' AS media_type FROM documents")
def item_to_observation(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("documents:"), F.col("doc_id")).alias("id"), F.col("source").alias("source_platform"), F.col("doc_id").cast("string").alias("source_id"), text.filled(F.col("text")).alias("raw_text"), "lang", F.lit("TEXT").alias("media_type"))


@query("prj03_text_for_chunking", "SELECT conv_id, turn, concat_ws(chr(10), role, nullif(text, '')) AS body FROM conversations")
def text_for_chunking(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("\n", "role", F.nullif(F.col("text"), F.lit(""))).alias("body"))


@query("snk04_size_eviction", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def size_eviction(spark, d):
    return relational.top_per_group(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 2).select("conv_id", "turn")


@query("snk05_age_eviction", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def age_eviction(spark, d):
    return table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")).select("event_id")


@query("snk06_retention", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 30 DAY")
def retention(spark, d):
    return table(spark, d, "orders").where(F.expr("o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 30 DAY")).select(F.col("o_orderkey").alias("id"))


@query("snk07_remove_source", "SELECT doc_id FROM documents WHERE NOT (lang = 'en' AND source = 'src3')")
def remove_source(spark, d):
    return table(spark, d, "documents").where(~((F.col("lang") == "en") & (F.col("source") == "src3"))).select("doc_id")


@query("flt15_publication_gate", """SELECT doc_id, coalesce(CASE WHEN n_chars < 100 THEN 'quality' END, CASE WHEN quality = 0 THEN 'citation' END, CASE WHEN toxic = 1 THEN 'safety' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'policy' END, 'published') AS step FROM documents JOIN labels USING (doc_id)""")
def publication_gate(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id")
    steps = [F.when(F.col("n_chars") < 100, "quality"), F.when(F.col("quality") == 0, "citation"), F.when(F.col("toxic") == 1, "safety"), F.when(~F.col("lang").isin("en", "de", "fr"), "policy")]
    return both.select("doc_id", F.coalesce(*steps, F.lit("published")).alias("step"))


#: Greedy budget per key over rows o (key, i, doc_id, n_chars), i from 1: a row that doesn't fit is skipped.
BUDGET = """SELECT key, doc_id, i, n_chars <= {most} AS taken, CASE WHEN n_chars <= {most} THEN n_chars ELSE 0 END AS used FROM o WHERE i = 1
 UNION ALL SELECT o.key, o.doc_id, o.i, r.used + o.n_chars <= {most}, r.used + CASE WHEN r.used + o.n_chars <= {most} THEN o.n_chars ELSE 0 END FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1"""


@query("flt05_char_budget", f"""WITH RECURSIVE o AS (SELECT source AS key, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), r AS ({BUDGET.format(most=100_000)})
SELECT key AS source, doc_id, n_chars, taken FROM r JOIN documents USING (doc_id)""")
def char_budget(spark, d):
    return relational.char_budget(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 100_000)


@query("flt06_connector_filter", rf"""WITH RECURSIVE p AS (SELECT doc_id, lang, source, text, CASE WHEN source = 'src9' THEN 'platform_gate' WHEN contains(lower(text), 'thing') THEN 'keyword_blocklist' END AS early, sha1(source || '||' || substr(text, 1, 64)) AS fp FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY lang, fp, early IS NULL ORDER BY doc_id) AS n, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS u, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS l FROM p),
s AS (SELECT doc_id, lang, length(text) AS c, CASE WHEN early IS NOT NULL THEN early WHEN n > 1 THEN 'deduplication' WHEN u >= 0.7 * l AND l > 0 THEN 'bot_detection' WHEN c < 20 THEN 'min_text_length' END AS stage FROM q),
o AS (SELECT lang AS key, doc_id, CASE WHEN stage IS NULL THEN c ELSE 0 END AS n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM s), r AS ({BUDGET.format(most=200_000)})
SELECT doc_id, coalesce(stage, CASE WHEN NOT taken THEN 'char_budget' END) AS drop_stage FROM s JOIN r USING (doc_id)""")
def connector_filter(spark, d):
    """Documents as what a connector fetched for four users, a millisecond apart."""
    at = F.timestamp_micros(F.lit(1_705_320_000_000_000) + F.col("doc_id") * 1000)
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("user_id"), F.col("source").alias("platform"), *(F.lit(None).cast("string").alias(c) for c in ("author", "url", "title")), F.col("text").alias("raw_text"), at.alias("seen_at"))
    found = relational.connector_filter(docs, ["doc_id"], 200_000, keep=["doc_id"], platforms=[f"src{i}" for i in range(20) if i != 9], block=["thing"])
    return found.select("doc_id", "drop_stage")
