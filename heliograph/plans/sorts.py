"""Sorts, limits, top-k and pagination. Limits are what these operators are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational
from .registry import SIGNALS, query, signals, table


@query("s01_queue_page", f"SELECT id, action_score FROM ({SIGNALS}) ORDER BY action_score DESC, id LIMIT 50 OFFSET 100")
def queue_page(spark, d):
    return relational.page(signals(spark, d).select("id", "action_score"), [F.desc("action_score"), F.col("id")], 50, 100)


@query("s02_page_probe", f"SELECT id, created_at FROM ({SIGNALS}) ORDER BY created_at, id LIMIT 501")
def page_probe(spark, d):
    return relational.page(signals(spark, d).select("id", "created_at"), [F.col("created_at"), F.col("id")], 501)


@query("s03_rank_batch", f"SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY action_score DESC, id) AS INTEGER) AS rank FROM ({SIGNALS})")
def rank_batch(spark, d):
    from pyspark.sql.window import Window

    return signals(spark, d).select("user_id", "id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("action_score"), "id")).alias("rank"))


@query("s04_personal_rank", f"SELECT user_id, id, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY action_score * CASE signal_type WHEN '1-URGENT' THEN 1.5 ELSE 1 END DESC, id) AS n FROM ({SIGNALS})) WHERE n <= 5")
def personal_rank(spark, d):
    final = F.col("action_score") * F.when(F.col("signal_type") == "1-URGENT", 1.5).otherwise(1.0)
    return relational.top_per_group(signals(spark, d).withColumn("final", final), ["user_id"], [F.desc("final"), F.col("id")], 5).select("user_id", "id", "rank")


@query("s05_source_batch", "SELECT s_suppkey AS source_id, s_acctbal AS priority FROM supplier WHERE s_acctbal >= 1000 ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def source_batch(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal >= 1000").select(F.col("s_suppkey").alias("source_id"), F.col("s_acctbal").alias("priority"))
    return relational.page(s, [F.desc("priority"), F.col("source_id")], 20)


@query("s06_scheduler_batch", "SELECT s_suppkey AS source_id FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09 AND l_quantity > 49) ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def scheduler_batch(spark, d):
    bad = table(spark, d, "lineitem").where("l_discount > 0.09 AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return relational.page(table(spark, d, "supplier").join(bad, "s_suppkey", "left_anti"), [F.desc("s_acctbal"), F.col("s_suppkey")], 20).select(F.col("s_suppkey").alias("source_id"))


@query("s07_frontier", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url ORDER BY length(url), url LIMIT 100")
def frontier(spark, d):
    return relational.page(table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id")), [F.length("url"), F.col("url")], 100)


@query("s08_crawl_priority", "SELECT page_id, round(0.4 * (1 - least(length(url) / 100, 1)) + 0.3 * (1 - least(len(string_split(url, '/')) / 10, 1)) + 0.2 * (1 - CASE WHEN contains(url, '?') THEN 1 ELSE 0 END) + 0.1 * (1 - least(length(html) / 10000, 1)), 6) AS priority FROM pages")
def crawl_priority(spark, d):
    part = lambda w, x: w * (1 - F.least(x, F.lit(1.0)))
    p = part(0.4, F.length("url") / 100) + part(0.3, F.size(F.split("url", "/")) / 10) + part(0.2, F.contains("url", F.lit("?")).cast("double")) + part(0.1, F.length("html") / 10000)
    return table(spark, d, "pages").select("page_id", F.round(p, 8).alias("priority"))


@query("s09_exemplars_top", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS n FROM embeddings) WHERE n <= 10")
def exemplars_top(spark, d):
    e = table(spark, d, "embeddings").withColumn("confidence", F.col("embedding")[0])
    return relational.top_per_group(e, ["label"], [F.desc("confidence"), F.col("vec_id")], 10).select("label", "vec_id")


@query("s10_keyword_search", r"""SELECT doc_id, round(score, 8) AS score FROM (SELECT doc_id, ((length(t) - length(replace(t, 'the', ''))) / 3 + (length(t) - length(replace(t, 'ing', ''))) / 3) / greatest(len(regexp_extract_all(t, '\S+')), 1) AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def keyword_search(spark, d):
    t = F.lower("text")
    hits = lambda w: (F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)
    score = (hits("the") + hits("ing")) / F.greatest(F.regexp_count(t, F.lit(r"\S+")), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.round(score, 8).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


@query("s11_rerank", r"""SELECT doc_id, round(hits / greatest(n, 1), 8) AS score FROM (SELECT doc_id, len([w FOR w IN ws IF w IN ('the', 'la', 'de', 'und')]) AS hits, len(ws) AS n FROM (SELECT doc_id, [w FOR w IN regexp_split_to_array(lower(text), '\s+') IF w <> ''] AS ws FROM documents)) ORDER BY score DESC, doc_id LIMIT 50""")
def rerank(spark, d):
    ws = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    t = table(spark, d, "documents").select("doc_id", ws.alias("ws"))
    score = F.size(F.filter("ws", lambda w: w.isin("the", "la", "de", "und"))) / F.greatest(F.size("ws"), F.lit(1))
    return t.select("doc_id", F.round(score, 8).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("s12_top_interests", "SELECT event_type, round(sum(value), 4) AS weight FROM events GROUP BY event_type ORDER BY weight DESC, event_type LIMIT 3")
def top_interests(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("weight")).orderBy(F.desc("weight"), "event_type").limit(3)


@query("s13_cluster_rank", "SELECT source, count(*) AS size FROM documents GROUP BY source ORDER BY size DESC, source LIMIT 10")
def cluster_rank(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "source").limit(10)


S14_STOP = ", ".join(f"'{w}'" for w in text.FINGERPRINT_STOP_WORDS)


@query("s14_key_sentences", rf"""WITH s AS (SELECT conv_id, turn, role, unnest(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM conversations),
t AS (SELECT conv_id, turn, pos, w FROM (SELECT conv_id, turn, pos, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS w FROM s) WHERE length(w) >= 3 AND w NOT IN ({S14_STOP})),
tf AS (SELECT conv_id, w, count(*) AS n FROM t GROUP BY conv_id, w),
l AS (SELECT s.*, lower(substr(s.s, 1, 80)) AS k, coalesce((SELECT sum(n) FROM t JOIN tf USING (conv_id, w) WHERE t.conv_id = s.conv_id AND t.turn = s.turn AND t.pos = s.pos), 0) * CASE WHEN role = 'assistant' THEN 1.3 ELSE 1.0 END AS score FROM s WHERE length(s.s) >= 20),
u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY conv_id, k ORDER BY score DESC, turn, pos) = 1)
SELECT conv_id, s AS sentence, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn, pos) AS n FROM u) WHERE n <= 6""")
def key_sentences(spark, d):
    """A sentence scores the frequencies of its words in the conversation, times .5 and the trust in who says it (.8 or .5)."""
    s = table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split(F.trim("text"), r"(?<=[.!?])\s+")).alias("pos", "s"))
    t = s.select("conv_id", "turn", "pos", F.explode(F.regexp_extract_all(F.lower("s"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    t = t.where((F.length("w") >= 3) & ~F.col("w").isin(*text.FINGERPRINT_STOP_WORDS)).groupBy("conv_id", "w", "turn", "pos").agg(F.count("*").alias("here"))
    frequency = t.groupBy("conv_id", "w").agg(F.sum("here").alias("n"))
    weight = t.join(frequency, ["conv_id", "w"]).groupBy("conv_id", "turn", "pos").agg(F.sum(F.col("here") * F.col("n")).alias("weight"))
    trust = F.when(F.col("role") == "assistant", 1.3).otherwise(1.0)
    scored = s.where(F.length("s") >= 20).join(weight, ["conv_id", "turn", "pos"], "left").withColumns({"k": F.lower(F.substring("s", 1, 80)), "score": F.coalesce("weight", F.lit(0)) * trust})
    order = [F.desc("score"), F.col("turn"), F.col("pos")]
    unique = relational.top_per_group(scored, ["conv_id", "k"], order, 1, "first")
    return relational.top_per_group(unique, ["conv_id"], order, 6).select("conv_id", F.col("s").alias("sentence"), "rank")


@query("s15_top_keywords", r"""WITH w AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT item_id, [x FOR x IN regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+') IF x <> ''] AS ws FROM benchmark)),
c AS (SELECT item_id, w, count(*) AS n, min(pos) AS first FROM w WHERE length(w) > 3 GROUP BY ALL) SELECT item_id, string_agg(w, ',' ORDER BY n DESC, first) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first) AS k FROM c) WHERE k <= 10 GROUP BY item_id""")
def top_keywords(spark, d):
    ws = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != "")
    w = table(spark, d, "benchmark").select("item_id", F.posexplode(ws).alias("pos", "w")).where(F.length("w") > 3)
    c = w.groupBy("item_id", "w").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = relational.top_per_group(c, ["item_id"], [F.desc("n"), F.col("first")], 10)
    return best.groupBy("item_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda s: s["w"])).alias("keywords"))


@query("s16_quote_ranking", "SELECT conv_id, turn, round(importance, 6) AS importance FROM (SELECT conv_id, turn, least(length(text) / 500, 1) * 0.6 + CASE WHEN contains(text, '!') THEN 0.2 ELSE 0 END + CASE WHEN role = 'assistant' THEN 0.2 ELSE 0 END AS importance FROM conversations) WHERE importance >= 0.3 ORDER BY importance DESC, conv_id, turn LIMIT 25")
def quote_ranking(spark, d):
    importance = F.least(F.length("text") / 500, F.lit(1.0)) * 0.6 + F.when(F.contains("text", F.lit("!")), 0.2).otherwise(0.0) + F.when(F.col("role") == "assistant", 0.2).otherwise(0.0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(importance, 6).alias("importance")).where("importance >= 0.3").orderBy(F.desc("importance"), "conv_id", "turn").limit(25)


@query("s17_changelog_order", "SELECT p_partkey AS id, CAST(row_number() OVER (ORDER BY p_size DESC, p_brand, p_partkey) AS BIGINT) AS place FROM part WHERE p_size >= 45 ORDER BY place LIMIT 100")
def changelog_order(spark, d):
    first = table(spark, d, "part").where("p_size >= 45").orderBy(F.desc("p_size"), "p_brand", "p_partkey").limit(100)
    from pyspark.sql.window import Window

    return first.select(F.col("p_partkey").alias("id"), F.row_number().over(Window.orderBy(F.desc("p_size"), "p_brand", "p_partkey")).cast("long").alias("place"))


@query("s18_fetch_order", "SELECT s_suppkey AS source, round(s_acctbal / 1000 * least(1 + s_suppkey % 5, 3) * pow(0.5, s_suppkey % 3), 8) AS priority FROM supplier")
def fetch_order(spark, d):
    p = F.col("s_acctbal") / 1000 * F.least(1 + F.col("s_suppkey") % 5, F.lit(3)) * F.pow(F.lit(0.5), F.col("s_suppkey") % 3)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.round(p, 8).alias("priority"))


@query("s19_recent_history", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_history(spark, d):
    return relational.page(table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 100).select("event_id")


