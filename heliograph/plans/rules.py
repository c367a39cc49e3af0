"""Rule-based scorers of workflows, responses, registries and output."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import relational
from .registry import SIGNALS, query, signals, table

PAINS = {"cost": "expensive|cost|de", "speed": "slow|lag|the", "support": "support|help|und", "bugs": "bug|crash|error"}


def classes(rules: dict[str, str], default: str):
    hits = F.filter(F.array(*(F.when(F.lower("text").rlike(p), F.lit(c)) for c, p in rules.items())), lambda c: c.isNotNull())
    return F.when(F.size(hits) == 0, F.array(F.lit(default))).otherwise(hits)


PAIN_SQL = "[c FOR c IN [" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{c}' END" for c, p in PAINS.items()) + "] IF c IS NOT NULL]"


@query("r01_pain_points", f"SELECT conv_id, turn, CASE WHEN len({PAIN_SQL}) = 0 THEN 'general' ELSE array_to_string({PAIN_SQL}, ',') END AS pains FROM conversations")
def pain_points(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(",", classes(PAINS, "general")).alias("pains"))


@query("r02_current_tool", r"SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, '(?i)using (\w+)', 1), ''), nullif(regexp_extract(text, '(?i)(?:^|[^a-z])the (\w+)', 1), ''), nullif(regexp_extract(text, '(?i)(?:^|[^a-z])la (\w+)', 1), '')) AS tool FROM conversations")
def current_tool(spark, d):
    first = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(first(r"(?i)using (\w+)"), first(r"(?i)(?:^|[^a-z])the (\w+)"), first(r"(?i)(?:^|[^a-z])la (\w+)")).alias("tool"))


@query("r03_requirements", "SELECT conv_id, turn, regexp_matches(lower(text), '\\$|budget|price') AS budget, regexp_matches(lower(text), 'asap|urgent|now') AS urgent FROM conversations")
def requirements(spark, d):
    low = F.lower("text")
    return table(spark, d, "conversations").select("conv_id", "turn", low.rlike(r"\$|budget|price").alias("budget"), low.rlike("asap|urgent|now").alias("urgent"))


@query("r04_intent_clarity", f"SELECT conv_id, turn, CAST(round(least(0.15 * len({PAIN_SQL}), 0.4) + least(0.1 * len(string_split(text, chr(10))), 0.3), 6) AS DOUBLE) AS clarity FROM conversations")
def intent_clarity(spark, d):
    pains = F.size(F.filter(F.array(*(F.when(F.lower("text").rlike(p), F.lit(c)) for c, p in PAINS.items())), lambda c: c.isNotNull()))
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(F.least(0.15 * pains, F.lit(0.4)) + F.least(0.1 * F.size(F.split("text", "\n")), F.lit(0.3)), 6).alias("clarity"))


@query("r05_lead_score", f"SELECT id, CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS quality FROM (SELECT id, 0.30 * action_score + 0.25 * action_score + 0.20 * (user_id % 10) / 10 + 0.15 * 0.5 + 0.10 * 0.8 AS s FROM ({SIGNALS}))")
def lead_score(spark, d):
    s = 0.30 * F.col("action_score") + 0.25 * F.col("action_score") + 0.20 * (F.col("user_id") % 10) / 10 + 0.15 * F.lit(0.5) + 0.10 * F.lit(0.8)
    return signals(spark, d).select("id", F.when(s >= 0.75, "high").when(s >= 0.5, "medium").otherwise("low").alias("quality"))


@query("r06_churn_severity", f"SELECT id, CASE WHEN s >= 0.75 THEN 'critical' WHEN s >= 0.55 THEN 'high' WHEN s >= 0.35 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT id, least(0.6 * action_score + 0.3 * CASE WHEN signal_type = '1-URGENT' THEN 1 ELSE 0 END, 1) AS s FROM ({SIGNALS}))")
def churn_severity(spark, d):
    s = F.least(0.6 * F.col("action_score") + 0.3 * F.when(F.col("signal_type") == "1-URGENT", 1).otherwise(0), F.lit(1.0))
    return signals(spark, d).select("id", F.when(s >= 0.75, "critical").when(s >= 0.55, "high").when(s >= 0.35, "medium").otherwise("low").alias("severity"))


@query("r07_churn_drivers", f"SELECT doc_id, CASE WHEN len({PAIN_SQL}) = 0 THEN 'unknown' ELSE array_to_string({PAIN_SQL}, ',') END AS drivers FROM documents")
def churn_drivers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", classes(PAINS, "unknown")).alias("drivers"))


STRATEGY = "(VALUES ('NEW', '1-URGENT', 'call'), ('NEW', '2-HIGH', 'offer'), ('IN_PROGRESS', '1-URGENT', 'escalate')) AS r(status, signal_type, strategy)"


@query("r08_retention_strategy", f"SELECT s.id, coalesce(strategy, 'mail') AS strategy FROM ({SIGNALS}) s LEFT JOIN {STRATEGY} ON r.status = s.status AND r.signal_type = s.signal_type")
def retention_strategy(spark, d):
    rules = spark.sql(f"SELECT * FROM {STRATEGY}")
    return signals(spark, d).join(F.broadcast(rules), ["status", "signal_type"], "left").select("id", F.coalesce("strategy", F.lit("mail")).alias("strategy"))


@query("r09_complaint_category", "SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN 'security' WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), '@') THEN 'contact' ELSE 'other' END AS category FROM documents")
def complaint_category(spark, d):
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    return table(spark, d, "documents").select("doc_id", F.when(has("password"), "security").when(has("license"), "legal").when(has("@"), "contact").otherwise("other").alias("category"))


@query("r10_polarity", "SELECT doc_id, CASE WHEN pos + neg = 0 THEN 0.0 ELSE round((pos - neg) / (pos + neg), 6) END AS polarity, round(least((pos + neg) / 10, 1), 6) AS intensity FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '(^|\\s)(the|la|und)(\\s|$)')) AS pos, len(regexp_extract_all(lower(text), '(^|\\s)(of|de|nicht)(\\s|$)')) AS neg FROM documents)".replace("\\\\", "\\"))
def polarity(spark, d):
    pos, neg = (F.regexp_count(F.lower("text"), F.lit(rf"(^|\s)({w})(\s|$)")) for w in ("the|la|und", "of|de|nicht"))
    return table(spark, d, "documents").select("doc_id", F.when(pos + neg == 0, 0.0).otherwise(F.round((pos - neg) / (pos + neg), 6)).alias("polarity"), F.round(F.least((pos + neg) / 10, F.lit(1.0)), 6).alias("intensity"))


@query("r11_recurring_pattern", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) >= 2 AS recurring FROM events")
def recurring_pattern(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (F.row_number().over(w) >= 2).alias("recurring"))


@query("r12_workflow_choice", f"SELECT id, CASE signal_type WHEN '1-URGENT' THEN 'churn_prevention' WHEN '2-HIGH' THEN 'alternative_seeker' ELSE 'competitor_intelligence' END AS workflow FROM ({SIGNALS})")
def workflow_choice(spark, d):
    return signals(spark, d).select("id", F.when(F.col("signal_type") == "1-URGENT", "churn_prevention").when(F.col("signal_type") == "2-HIGH", "alternative_seeker").otherwise("competitor_intelligence").alias("workflow"))


@query("r13_draft_quality", "SELECT conv_id, turn, round(0.4 * CASE WHEN length(text) BETWEEN 50 AND 1500 THEN 1.0 ELSE 0.5 END + 0.3 * CASE WHEN contains(text, '?') THEN 1.0 ELSE 0.4 END + 0.3 * least(len(string_split(text, ' ')) / 100, 1), 6) AS quality FROM conversations")
def draft_quality(spark, d):
    q = 0.4 * F.when(F.length("text").between(50, 1500), 1.0).otherwise(0.5) + 0.3 * F.when(F.contains("text", F.lit("?")), 1.0).otherwise(0.4) + 0.3 * F.least(F.size(F.split("text", " ")) / 100, F.lit(1.0))
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(q, 6).alias("quality"))


@query("r14_consensus_vote", """WITH c AS (SELECT conv_id, turn, least(length(text) / 1000, 1) AS q, len(string_split(text, '.')) / 10 AS coh FROM conversations), s AS (SELECT conv_id, turn, 0.4 * q + 0.3 * (1 - abs(coh - avg(coh) OVER (PARTITION BY conv_id))) + 0.2 * q + 0.1 * (1 - turn / 100) AS score FROM c)
SELECT conv_id, turn AS winner FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, turn) AS n FROM s) WHERE n = 1""")
def consensus_vote(spark, d):
    q, coh = F.least(F.length("text") / 1000, F.lit(1.0)), F.size(F.split("text", r"\.")) / 10
    c = table(spark, d, "conversations").select("conv_id", "turn", q.alias("q"), coh.alias("coh")).withColumn("mean", F.avg("coh").over(Window.partitionBy("conv_id")))
    c = c.withColumn("score", F.round(0.4 * F.col("q") + 0.3 * (1 - F.abs(F.col("coh") - F.col("mean"))) + 0.2 * F.col("q") + 0.1 * (1 - F.col("turn") / 100), 9))
    return relational.top_per_group(c, ["conv_id"], [F.desc("score"), F.col("turn")], 1).select("conv_id", F.col("turn").alias("winner"))


@query("r15_conciseness", "SELECT conv_id, turn, CASE WHEN length(text) < 200 THEN 1.0 WHEN length(text) < 800 THEN 0.8 WHEN length(text) < 2000 THEN 0.5 ELSE 0.2 END AS conciseness FROM conversations".replace("1.0 WHEN", "CAST(1.0 AS DOUBLE) WHEN"))
def conciseness(spark, d):
    n = F.length("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(n < 200, 1.0).when(n < 800, 0.8).when(n < 2000, 0.5).otherwise(0.2).alias("conciseness"))


@query("r16_truncate_words", r"SELECT doc_id, array_to_string(regexp_split_to_array(text, '\s+')[1:50], ' ') AS head FROM documents")
def truncate_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.split("text", r"\s+"), 1, 50), " ").alias("head"))


@query("r17_tenant_tier", "SELECT user_id AS tenant, CASE WHEN n >= 300 THEN 'enterprise' WHEN n >= 100 THEN 'pro' ELSE 'free' END AS tier FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def tenant_tier(spark, d):
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("tenant")).agg(F.count("*").alias("n"))
    return n.select("tenant", F.when(F.col("n") >= 300, "enterprise").when(F.col("n") >= 100, "pro").otherwise("free").alias("tier"))


@query("r18_key_phrases", r"""WITH p AS (SELECT lang, unnest(regexp_extract_all(text, '\p{Lu}\p{L}+ \p{L}+')) AS phrase FROM documents) SELECT lang, phrase, n FROM (SELECT lang, phrase, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, phrase) AS k FROM p GROUP BY lang, phrase) WHERE k <= 20""")
def key_phrases(spark, d):
    p = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+ \p{L}+"), F.lit(0))).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("n"))
    return relational.top_per_group(p, ["lang"], [F.desc("n"), F.col("phrase")], 20).drop("rank")


@query("r19_model_promotion", "SELECT label AS model, arg_min(vec_id, (abs(embedding[1]), vec_id)) AS production FROM embeddings GROUP BY label")
def model_promotion(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("model")).agg(F.min_by("vec_id", F.struct(F.abs(F.col("embedding")[0]), "vec_id")).alias("production"))


@query("r21_source_discovery", "SELECT lang AS topic, source, max(n_chars) AS confidence FROM documents WHERE contains(source, '1') GROUP BY ALL")
def source_discovery(spark, d):
    return table(spark, d, "documents").where(F.contains("source", F.lit("1"))).groupBy(F.col("lang").alias("topic"), "source").agg(F.max("n_chars").alias("confidence"))


@query("r22_source_score")
def source_score(spark, d):
    """Boost .05 for each success up to .15, penalty .10 for each failure down to -.40; both fold in order."""
    from ..operators.folds import ordered_fold

    def step(state, row):
        boost, penalty = state
        state = (boost, max(-0.40, penalty - 0.10)) if row["event_type"] == "error" else (min(0.15, boost + 0.05), penalty)
        return state, {"score": max(0.0, min(1.0, 0.5 + sum(state)))}

    e = table(spark, d, "events").select("user_id", F.unix_micros("ts").alias("at"), "event_id", "event_type")
    return ordered_fold(e, ["user_id"], ["at", "event_id"], lambda: (0.0, 0.0), step, "score double").select("event_id", F.round("score", 6).alias("score"))


@query("r23_feed_expansion", r"SELECT DISTINCT 'http://' || host || p AS feed FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages), (VALUES ('/feed'), ('/rss.xml'), ('/atom.xml')) AS f(p)")
def feed_expansion(spark, d):
    host = text.url_host(F.col("url"))
    return table(spark, d, "pages").select(host.alias("host")).distinct().select(F.explode(F.array(*(F.concat(F.lit("http://"), F.col("host"), F.lit(p)) for p in ("/feed", "/rss.xml", "/atom.xml")))).alias("feed"))


@query("r24_episode_entities", r"""WITH e AS (SELECT conv_id, unnest(regexp_extract_all(text, '\p{Lu}\p{L}+')) AS entity FROM conversations) SELECT conv_id, entity, n FROM (SELECT conv_id, entity, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, entity) AS k FROM e GROUP BY conv_id, entity HAVING count(*) >= 2) WHERE k <= 50""")
def episode_entities(spark, d):
    e = table(spark, d, "conversations").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), F.lit(0))).alias("entity")).groupBy("conv_id", "entity").agg(F.count("*").alias("n")).where("n >= 2")
    return relational.top_per_group(e, ["conv_id"], [F.desc("n"), F.col("entity")], 50).drop("rank")


@query("r25_paper_claims", r"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(?:^|[^a-z])(?:limitation|of)(?:[^a-z]|$)') THEN 'limitation' WHEN regexp_matches(lower(text), '(?:^|[^a-z])(?:future|de)(?:[^a-z]|$)') THEN 'future' WHEN regexp_matches(lower(text), '(?:^|[^a-z])(?:propose|und)(?:[^a-z]|$)') THEN 'contribution' ELSE 'default' END AS class FROM documents")
def paper_claims(spark, d):
    has = lambda p: F.lower("text").rlike(rf"(?:^|[^a-z])(?:{p})(?:[^a-z]|$)")
    return table(spark, d, "documents").select("doc_id", F.when(has("limitation|of"), "limitation").when(has("future|de"), "future").when(has("propose|und"), "contribution").otherwise("default").alias("class"))


@query("r26_risk_escalation", f"SELECT user_id, bool_or(signal_type = '1-URGENT' AND action_score > 0.5) AS escalate FROM ({SIGNALS}) GROUP BY user_id")
def risk_escalation(spark, d):
    return signals(spark, d).groupBy("user_id").agg(F.bool_or((F.col("signal_type") == "1-URGENT") & (F.col("action_score") > 0.5)).alias("escalate"))


@query("r27_media_evidence", r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)\.(?:png|jpe?g|gif|mp4|webm)(?:[^a-z0-9]|$)')) AS BIGINT) AS media FROM pages")
def media_evidence(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit(r"(?i)\.(?:png|jpe?g|gif|mp4|webm)(?:[^a-z0-9]|$)")).cast("long").alias("media"))


@query("r28_token_expiry", "SELECT o_orderkey AS id, o_orderdate + INTERVAL 5 MINUTE >= TIMESTAMP '1998-01-01' AS valid FROM orders")
def token_expiry(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_orderdate + INTERVAL 5 MINUTES >= TIMESTAMP '1998-01-01'").alias("valid"))


@query("r30_role_masking", "SELECT c_custkey AS id, CASE WHEN c_nationkey >= 10 THEN c_name END AS name, CASE WHEN c_nationkey >= 20 THEN c_acctbal END AS balance FROM customer")
def role_masking(spark, d):
    level = F.col("c_nationkey")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(level >= 10, F.col("c_name")).alias("name"), F.when(level >= 20, F.col("c_acctbal")).alias("balance"))
