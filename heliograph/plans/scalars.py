"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import claims as conflicts
from ..functions import rules, sanitizing, scores, text
from ..operators import relational
from .registry import SIGNALS, query, signals, table

SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"
DROPPED = ", ".join(f"'{p}'" for p in text.TRACKING_PARAMS)


@query("f01_canonical_url", rf"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, lower(regexp_extract(url, '{SCHEME}([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '{SCHEME}[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
 array_to_string([p FOR p IN string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&') IF contains(p, '=') AND NOT ends_with(p, '=') AND lower(split_part(p, '=', 1)) NOT IN ({DROPPED})], '&') AS q FROM pages)
SELECT page_id, lower(scheme) || '://' || CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE host END || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM u""")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", text.normal_url(F.col("url")).alias("url"))


CLEANED = ", ".join(f"'{p}'" for p in text.CLEANED_PARAMS)


@query("f02_clean_url", rf"""WITH u AS (SELECT page_id, url, array_to_string([p FOR p IN string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&') IF contains(p, '=') AND NOT ends_with(p, '=') AND lower(split_part(p, '=', 1)) NOT IN ({CLEANED})], '&') AS q FROM pages)
SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM u""")
def clean_url(spark, d):
    return table(spark, d, "pages").select("page_id", text.cleaned_url(F.col("url")).alias("url"))


@query("f03_clean_text", r"SELECT page_id, md5(replace(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), chr(0), '')) AS body FROM pages")
def clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.clean(F.col("html"))).alias("body"))


@query("f04_merge_text", r"SELECT conv_id, turn, md5(trim(regexp_replace(concat_ws(chr(10), role, text), '\s+', ' ', 'g'))) AS body FROM conversations")
def merge_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.trim(F.regexp_replace(F.concat_ws("\n", "role", "text"), r"\s+", " "))).alias("body"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("f05_scrub", rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS BIGINT) AS n, md5(regexp_replace(text, '{EMAIL}', '<email>', 'g')) AS scrubbed FROM documents")
def scrub(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(EMAIL)).cast("long").alias("n"), F.md5(F.regexp_replace("text", EMAIL, "<email>")).alias("scrubbed"))


@query("f06_pseudonym", "SELECT c_custkey AS id, 'anon_' || substr(sha256(c_name), 1, 16) AS alias FROM customer")
def pseudonym(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), rules.pseudonym(F.col("c_name")).alias("alias"))


@query("f07_redact_url", r"SELECT page_id, regexp_replace(url, '([?&](?:ref|page|email|token|user))=[^&#]*', '\1=<redacted>', 'g') AS url FROM pages")
def redact_url(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "([?&](?:ref|page|email|token|user))=[^&#]*", "$1=<redacted>").alias("url"))


@query("f08_redaction_audit", rf"SELECT doc_id, kind, n FROM (SELECT doc_id, 'email' AS kind, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS BIGINT) AS n FROM documents UNION ALL SELECT doc_id, 'digits', CAST(len(regexp_extract_all(text, '[0-9]{{8,}}')) AS BIGINT) FROM documents) WHERE n > 0")
def redaction_audit(spark, d):
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for k, p in (("email", EMAIL), ("digits", "[0-9]{8,}"))))
    return table(spark, d, "documents").select("doc_id", F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("f")).select("doc_id", "f.kind", "f.n")


@query("f09_sanitize", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(substr(text, 1, 50000), '(?i)ignore (all|previous) instructions', '[removed]', 'g'), '(?i)system prompt', '[removed]', 'g')) AS body FROM documents""")
def sanitize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(rules.sanitized(F.col("text"), ("ignore (all|previous) instructions", "system prompt"))).alias("body"))


@query("f09_sanitized_pages", sanitizing.oracle_sql("pages", "page_id", "html"))
def sanitized_pages(spark, d):
    """Raw pages through all patterns, with the hits of each threat class."""
    found = table(spark, d, "pages").select("page_id", sanitizing.sanitized(F.col("html")).alias("s"))
    return found.select("page_id", F.md5("s.text").alias("body"), "s.modified", *(f"s.{c}" for c in sanitizing.classes()))


@query("f10_engagement", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.score') AS BIGINT), TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS engagement FROM events")
def engagement(spark, d):
    return table(spark, d, "events").select("event_id", rules.engagement(F.col("props"), ("score", "k")).alias("engagement"))


@query("f11_velocity", "SELECT l_orderkey AS id, l_linenumber AS line, (l_quantity + l_tax + l_discount) / ((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(l_shipdate)) / 3.6e9) AS velocity, CASE WHEN l_discount > 0 THEN least(l_discount / (l_quantity + l_tax + 1), 1) END AS virality FROM lineitem WHERE l_shipdate < TIMESTAMP '2002-01-01'")
def velocity(spark, d):
    likes, shares, comments = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    now = F.lit("2002-01-01").cast("timestamp")
    v, w = rules.velocity_virality(likes, shares, comments, scores.hours_between(now, F.col("l_shipdate")))
    return table(spark, d, "lineitem").where(F.col("l_shipdate") < now).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), v.alias("velocity"), w.alias("virality"))


@query("f12_quality", "SELECT doc_id, round(least(CAST(0.5 AS DOUBLE) + CASE WHEN length(text) > 100 THEN 0.2 ELSE 0 END + CASE WHEN length(text) > 500 THEN 0.2 ELSE 0 END + CASE WHEN lang = 'fr' THEN 0.1 ELSE 0 END, 1), 4) AS quality, round(least(CAST(0 AS DOUBLE) + CASE WHEN text <> '' THEN 0.4 ELSE 0 END + CASE WHEN source <> '' THEN 0.1 ELSE 0 END + 0.2, 1), 4) AS completeness FROM documents")
def quality(spark, d):
    q, c = rules.quality_completeness(F.col("text"), F.lit(None).cast("string"), F.col("source"), F.lit(True), F.col("lang") == "fr")
    return table(spark, d, "documents").select("doc_id", F.round(q, 4).alias("quality"), F.round(c, 4).alias("completeness"))


LEX = {"the": 0.5, "and": 0.3, "la": 0.4, "nicht": -0.8, "pas": -0.7, "of": -0.2}


@query("f13_sentiment", rf"""SELECT conv_id, turn, CASE WHEN s >= 0.2 THEN 'positive' WHEN s <= -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment FROM (SELECT conv_id, turn, list_sum([CASE w {" ".join(f"WHEN '{k}' THEN {v}" for k, v in LEX.items())} ELSE 0.0 END FOR w IN ws]) / sqrt(greatest(len(ws), 1)) AS s
 FROM (SELECT conv_id, turn, [w FOR w IN regexp_split_to_array(lower(text), '\s+') IF w <> ''] AS ws FROM conversations))""")
def sentiment(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", rules.sentiment(F.col("text"), LEX).alias("sentiment"))


@query("f14_language")
def language(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.language(F.col("text")).alias("language"))


@query("f15_entities", r"SELECT conv_id, turn, CAST(len(list_distinct(regexp_extract_all(text, '\p{Lu}\p{L}+'))) AS BIGINT) AS entities FROM conversations")
def entities(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), F.lit(0)))).cast("long").alias("entities"))


@query("f16_claims")
def claims(spark, d):
    return table(spark, d, "documents").select("doc_id", F.to_json(text.claims(F.col("text"))).alias("claims"))


@query("f17_title_jaccard", r"""WITH t AS (SELECT conv_id, turn, list_distinct([w FOR w IN regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+') IF w <> '']) AS ws FROM conversations), p AS (SELECT conv_id, turn, ws, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)
SELECT conv_id, turn, round(CASE WHEN len(ws) = 0 OR len(before) = 0 THEN 0 ELSE len(list_intersect(ws, before)) / len(list_distinct(list_concat(ws, before))) END, 6) AS similarity FROM p WHERE before IS NOT NULL""")
def title_jaccard(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("ws")).withColumn("before", F.lag("ws").over(w)).where("before IS NOT NULL")
    return t.select("conv_id", "turn", F.round(text.jaccard(F.col("ws"), F.col("before")), 6).alias("similarity"))


STOP_SQL = ", ".join(f"'{w}'" for w in text.FINGERPRINT_STOP_WORDS)


@query("f18_content_fingerprint", rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS pos FROM documents WHERE lang = 'en'),
c AS (SELECT doc_id, w, count(*) AS n, min(pos) AS first FROM t WHERE length(w) >= 3 AND w NOT IN ({STOP_SQL}) GROUP BY doc_id, w),
k AS (SELECT doc_id, w FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) <= 30)
SELECT d.doc_id, CASE WHEN d.lang <> 'en' THEN lower(d.lang) ELSE coalesce((SELECT string_agg(w, ',' ORDER BY w) FROM k WHERE k.doc_id = d.doc_id), '') END AS fingerprint FROM documents d""")
def content_fingerprint(spark, d):
    """Topics where there are any (here the languages other than English stand for them), else the 30 most frequent words."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("lang") == "en", F.lower("text")).alias("low"))
    top = relational.frequent_words(docs, "low", "words", 30, 3, text.FINGERPRINT_STOP_WORDS)
    return top.select("doc_id", F.when(F.col("lang") != "en", F.lower("lang")).otherwise(F.coalesce("words", F.lit(""))).alias("fingerprint"))


@query("f19_levenshtein", "SELECT p_partkey AS id, levenshtein(p_name, p_type) AS distance FROM part")
def levenshtein(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query("f20_alias_variants", r"""SELECT c_custkey AS id, array_to_string(list_sort(list_distinct([lower(c_name), regexp_replace(lower(c_name), '[^a-z0-9 ]', '', 'g'), replace(lower(c_name), '#', ' '), regexp_replace(lower(c_name), '^(the|a|an) ', '')])), '|') AS variants FROM customer""")
def alias_variants(spark, d):
    low = F.lower("c_name")
    every = F.array(low, F.regexp_replace(low, "[^a-z0-9 ]", ""), F.replace(low, F.lit("#"), F.lit(" ")), F.regexp_replace(low, "^(the|a|an) ", ""))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("|", F.array_sort(F.array_distinct(every))).alias("variants"))


@query("f21_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


@query("f22_hash_embedding")
def hash_embedding(spark, d):
    return table(spark, d, "benchmark").select("item_id", rules.hashed_words(F.col("text"), 512).alias("embedding"))


@query("f23_fused_embeddings", "SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 5) AS mean FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, i")
def fused_embeddings(spark, d):
    each = table(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return each.groupBy("label", "i").agg(F.round(F.avg("x"), 5).alias("mean"))


@query("f24_recency_engagement", "SELECT event_id, round(exp(-(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9 / 24), 8) AS recency, round(least(log10(1 + value) / 4, 1), 8) AS engagement FROM events")
def recency_engagement(spark, d):
    age = scores.hours_between(F.lit("2024-02-01").cast("timestamp"), F.col("ts"))
    return table(spark, d, "events").select("event_id", F.round(scores.decay(age, 24.0), 8).alias("recency"), F.round(F.least(F.log10(1 + F.col("value")) / 4, F.lit(1.0)), 8).alias("engagement"))


@query("f25_weighted_relevance", "SELECT event_id, round((0.4 * coalesce(a, 0) + 0.3 * b + 0.2 * coalesce(c, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.4 END + 0.3 + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END), 6) AS relevance FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN value / 50 END AS a, user_id / 200 AS b, nullif(value, 0) / 100 AS c FROM events)")
def weighted_relevance(spark, d):
    parts = [(0.4, F.when(F.col("event_type") != "view", F.col("value") / 50)), (0.3, F.col("user_id") / 200), (0.2, F.nullif(F.col("value"), F.lit(0.0)) / 100)]
    return table(spark, d, "events").select("event_id", F.round(rules.weighted(parts), 6).alias("relevance"))


@query("f26_personal_score", f"SELECT id, round(least(1, b * 0.9 + 0.1 * boost) * 0.9 + 0.1 * CASE WHEN signal_type = '1-URGENT' THEN 0.8 ELSE 0 END, 6) AS score FROM (SELECT *, 0.30 * action_score + 0.25 * 0.5 + 0.20 * action_score + 0.10 * 0.3 + 0.10 * 0.6 + 0.05 * 1.0 AS b, least(1, user_id % 10 / 10) AS boost FROM ({SIGNALS}))")
def personal_score(spark, d):
    s = F.col("action_score")
    base = 0.30 * s + 0.25 * F.lit(0.5) + 0.20 * s + 0.10 * F.lit(0.3) + 0.10 * F.lit(0.6) + 0.05 * F.lit(1.0)
    boost, watch = F.least(F.lit(1.0), F.col("user_id") % 10 / 10), F.when(F.col("signal_type") == "1-URGENT", 0.8).otherwise(0.0)
    return signals(spark, d).select("id", F.round(rules.boosted(base, boost, watch), 6).alias("score"))


@query("f27_trust_composite", "SELECT s_suppkey AS source, round(0.35 * CASE WHEN s_nationkey < 5 THEN 1.0 ELSE 0.3 END + 0.20 * greatest(0, 1 - late / 100) + 0.30 * CASE WHEN n >= 10 THEN ok / n ELSE 0.5 END + 0.15 * 0.5, 6) AS trust FROM supplier JOIN (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS ok, avg(l_quantity) AS late FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey")
def trust_composite(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("ok"), F.avg("l_quantity").alias("late"))
    both = table(spark, d, "supplier").join(g, "s_suppkey")
    return both.select(F.col("s_suppkey").alias("source"), F.round(rules.trust(F.col("s_nationkey") < 5, F.col("late") / 100, F.col("ok"), F.col("n"), F.lit(0.5)), 6).alias("trust"))


@query("f28_authority", "SELECT c_custkey AS id, round(least(ln(1 + greatest(c_acctbal, 0)) / ln(1 + 10000.0), 1), 8) AS authority FROM customer")
def authority(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(scores.authority(F.greatest("c_acctbal", F.lit(0.0)), 10000.0), 8).alias("authority"))


@query("f29_effective_trust", "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.0 WHEN c_mktsegment = 'BUILDING' THEN 0.9 WHEN c_mktsegment = 'FURNITURE' THEN round(least(greatest(c_acctbal / 10000 * 1.2, 0), 1), 6) ELSE round(c_acctbal / 10000, 6) END AS trust FROM customer")
def effective_trust(spark, d):
    base, seg = F.col("c_acctbal") / 10000, F.col("c_mktsegment")
    trust = F.when(seg == "MACHINERY", 0.0).when(seg == "BUILDING", 0.9).when(seg == "FURNITURE", F.round(scores.clamp(base * 1.2), 6)).otherwise(F.round(base, 6))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), trust.alias("trust"))


@query("f30_action_priority", f"""SELECT id, round(p, 6) AS priority, CASE WHEN p >= 0.8 THEN 'CRITICAL' WHEN p >= 0.6 THEN 'HIGH' WHEN p >= 0.4 THEN 'MEDIUM' WHEN p >= 0.2 THEN 'LOW' ELSE 'MONITOR' END AS level FROM (SELECT id, 0.35 * action_score + 0.30 * least(1, action_score + CASE WHEN signal_type = '1-URGENT' THEN 0.15 ELSE 0 END) + 0.35 * (1 - action_score / 2) AS p FROM ({SIGNALS}))""")
def action_priority(spark, d):
    s = F.col("action_score")
    p = rules.action_priority(s, s, 1 - s / 2, F.col("signal_type") == "1-URGENT")
    return signals(spark, d).select("id", F.round(p, 6).alias("priority"), rules.priority_level(p).alias("level"))


@query("f31_action_score", "SELECT event_id, round(least(greatest(0.25 * value / 50 + 0.2 * user_id / 200 + 0.15 - 0.1 * CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, 0), 1), 6) AS score FROM events")
def action_score(spark, d):
    s = 0.25 * F.col("value") / 50 + 0.2 * F.col("user_id") / 200 + 0.15 - 0.1 * F.when(F.col("event_type") == "error", 1).otherwise(0)
    return table(spark, d, "events").select("event_id", F.round(scores.clamp(s), 6).alias("score"))


INTENT = {"access": "password|token|secret", "legal": "license|licensed", "contact": "@|\\+1 "}


@query("f32_intent_classes", "SELECT doc_id, class, CAST(round(least(0.5 + 0.1 * hits, 0.9), 4) AS DOUBLE) AS confidence FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS class, len(regexp_extract_all(text, '{p}')) AS hits FROM documents" for c, p in INTENT.items()) + ") WHERE hits > 0")
def intent_classes(spark, d):
    every = F.array(*(F.struct(F.lit(c).alias("class"), F.regexp_count("text", F.lit(p)).alias("hits")) for c, p in INTENT.items()))
    return table(spark, d, "documents").select("doc_id", F.explode(F.filter(every, lambda x: x["hits"] > 0)).alias("x")).select("doc_id", "x.class", F.round(F.least(0.5 + 0.1 * F.col("x.hits"), F.lit(0.9)), 4).alias("confidence"))


@query("f33_sla_expiry", f"SELECT id, created_at + to_microseconds(CAST(round(24 * (1 - action_score / 2) * 3600) AS BIGINT) * 1000000) AS expires_at FROM ({SIGNALS})")
def sla_expiry(spark, d):
    seconds = F.round(24 * (1 - F.col("action_score") / 2) * 3600).cast("long")
    return signals(spark, d).select("id", F.timestamp_micros(F.unix_micros("created_at") + seconds * 1_000_000).alias("expires_at"))


@query("f34_platform_priors", "SELECT doc_id, class, prior FROM documents JOIN (VALUES ('src0', 'complaint', 0.4), ('src0', 'question', 0.3), ('src1', 'praise', 0.5)) AS p(source, class, prior) USING (source)".replace("prior FROM", "CAST(prior AS DOUBLE) AS prior FROM"))
def platform_priors(spark, d):
    priors = spark.sql("SELECT source, class, CAST(prior AS DOUBLE) AS prior FROM (VALUES ('src0', 'complaint', 0.4), ('src0', 'question', 0.3), ('src1', 'praise', 0.5)) AS p(source, class, prior)")
    return table(spark, d, "documents").select("doc_id", "source").join(F.broadcast(priors), "source").select("doc_id", "class", "prior")


@query("f35_claim_type", r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\d+%') THEN 'statistical' WHEN regexp_matches(lower(text), '(?:^|[^a-z])(?:than|versus)(?:[^a-z]|$)') THEN 'comparative' WHEN regexp_matches(lower(text), '(?:^|[^a-z])(?:will|going to)(?:[^a-z]|$)') THEN 'predictive' ELSE 'factual' END AS claim_type, regexp_matches(lower(text), '(?:^|[^a-z])(?:not|no|never|pas|nicht)(?:[^a-z]|$)') AS negated FROM conversations""")
def claim_type(spark, d):
    t, low = F.col("text"), F.lower("text")
    kind = F.when(t.rlike(r"\d+%"), "statistical").when(low.rlike(r"(?:^|[^a-z])(?:than|versus)(?:[^a-z]|$)"), "comparative").when(low.rlike(r"(?:^|[^a-z])(?:will|going to)(?:[^a-z]|$)"), "predictive").otherwise("factual")
    return table(spark, d, "conversations").select("conv_id", "turn", kind.alias("claim_type"), low.rlike(r"(?:^|[^a-z])(?:not|no|never|pas|nicht)(?:[^a-z]|$)").alias("negated"))


@query("f36_uncertainty", r"""WITH s AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM conversations)
SELECT conv_id, turn, round(avg(CASE WHEN regexp_matches(lower(s), '(?:^|[^a-z])(?:unknown|unclear)(?:[^a-z]|$)') THEN 1.0 WHEN regexp_matches(lower(s), '(?:^|[^a-z])(?:reportedly|allegedly)(?:[^a-z]|$)') THEN 0.75 WHEN regexp_matches(lower(s), '(?:^|[^a-z])(?:might|may|the)(?:[^a-z]|$)') THEN 0.5 WHEN regexp_matches(lower(s), '(?:^|[^a-z])(?:will|would|of)(?:[^a-z]|$)') THEN 0.25 END), 6) AS uncertainty FROM s WHERE s <> '' GROUP BY ALL""")
def uncertainty(spark, d):
    s = F.lower("s")
    level = F.when(s.rlike(r"(?:^|[^a-z])(?:unknown|unclear)(?:[^a-z]|$)"), 1.0).when(s.rlike(r"(?:^|[^a-z])(?:reportedly|allegedly)(?:[^a-z]|$)"), 0.75).when(s.rlike(r"(?:^|[^a-z])(?:might|may|the)(?:[^a-z]|$)"), 0.5).when(s.rlike(r"(?:^|[^a-z])(?:will|would|of)(?:[^a-z]|$)"), 0.25)
    each = table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.sentences(F.col("text"))).alias("s"))
    return each.groupBy("conv_id", "turn").agg(F.round(F.avg(level), 6).alias("uncertainty"))


@query("f37_contradictions", r"""WITH c AS (SELECT conv_id, turn, regexp_matches(lower(text), '(?:^|[^a-z])(?:not|no|pas|nicht)(?:[^a-z]|$)') AS neg, list_distinct([w FOR w IN regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+') IF length(w) >= 3]) AS ws FROM conversations)
SELECT a.conv_id, a.turn, 'MAJOR' AS severity FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.neg <> b.neg AND len(list_intersect(a.ws, b.ws)) >= 2""")
def contradictions(spark, d):
    """Neighbouring turns of which one is negated, with two shared words or more."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lower("text").rlike(r"(?:^|[^a-z])(?:not|no|pas|nicht)(?:[^a-z]|$)").alias("neg"), F.filter(text.words(F.col("text")), lambda x: F.length(x) >= 3).alias("ws"))
    c = c.withColumns({"neg2": F.lead("neg").over(w), "ws2": F.lead("ws").over(w), "turn2": F.lead("turn").over(w)})
    return c.where("turn2 = turn + 1 AND neg <> neg2 AND size(array_intersect(ws, ws2)) >= 2").select("conv_id", "turn", F.lit("MAJOR").alias("severity"))


STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in text.FINGERPRINT_STOP_WORDS) + "]"
NEGATION_SQL = "|".join(conflicts.NEGATIONS).replace("'", "''")
ANTONYM_SQL = "[" + ", ".join(f"['{x}', '{y}']" for p in conflicts.ANTONYMS for x, y in (p, p[::-1])) + "]"


@query("f37_contradiction_patterns", rf"""WITH b AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE text IS NOT NULL),
c AS (SELECT conv_id, turn, regexp_matches(t, '(?:^|[^\p{{L}}\p{{N}}_])(?:{NEGATION_SQL})(?:[^\p{{L}}\p{{N}}_]|$)') AS neg,
 list_distinct([w FOR w IN regexp_split_to_array(regexp_replace(t, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+') IF length(w) >= 3 AND NOT list_contains({STOPS_SQL}, w)]) AS ws, [w FOR w IN regexp_split_to_array(t, '\s+') IF w <> ''] AS ps FROM b),
g AS (SELECT conv_id, turn, neg, ws, ps, [CASE WHEN regexp_matches(w, '^\p{{L}}+$') AND NOT list_contains({STOPS_SQL}, w) THEN w END FOR w IN [regexp_replace(p, '[^\p{{L}}\p{{N}}_]', '', 'g') FOR p IN ps]] AS good FROM c),
n AS (SELECT conv_id, turn, anchor, arg_max(v, i) AS v FROM (SELECT conv_id, turn, i, ps[i] AS v, coalesce(CASE WHEN i > 1 THEN good[i - 1] END, CASE WHEN i > 2 THEN good[i - 2] END, CASE WHEN i > 3 THEN good[i - 3] END) AS anchor FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM g) WHERE regexp_matches(ps[i], '{conflicts.NUMBER}')) WHERE anchor IS NOT NULL GROUP BY ALL),
k AS (SELECT DISTINCT x.conv_id, x.turn FROM n x JOIN n y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 AND x.anchor = y.anchor AND x.v <> y.v),
p AS (SELECT a.conv_id, a.turn, a.neg <> b.neg AS differ, a.ws AS aw, b.ws AS bw, list_intersect(a.ws, b.ws) AS common, k.turn IS NOT NULL AS number FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN k ON k.conv_id = a.conv_id AND k.turn = a.turn),
r AS (SELECT conv_id, turn, CASE WHEN differ AND len(common) >= 2 THEN 'negation_conflict' WHEN number THEN 'number_conflict' WHEN len([x FOR x IN {ANTONYM_SQL} IF list_contains(aw, x[1]) AND list_contains(bw, x[2]) AND len([w FOR w IN common IF w <> x[1] AND w <> x[2]]) >= 1]) > 0 THEN 'antonym_conflict' END AS pattern FROM p)
SELECT conv_id, turn, pattern, CASE pattern WHEN 'negation_conflict' THEN 'MAJOR' WHEN 'number_conflict' THEN 'MODERATE' ELSE 'MINOR' END AS severity FROM r WHERE pattern IS NOT NULL""")
def contradiction_patterns(spark, d):
    """Neighbouring turns that contradict each other, by the first of three patterns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = F.col("text")
    c = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", conflicts.negated(t).alias("negated"), conflicts.content(t).alias("content"), conflicts.numbers(t).alias("numbers"))
    names = ("negated", "content", "numbers")
    c = c.withColumns({f"next_{n}": F.lead(n).over(w) for n in (*names, "turn")}).where("next_turn = turn + 1")
    found = conflicts.conflict({n: F.col(n) for n in names}, {n: F.col(f"next_{n}") for n in names})
    return c.select("conv_id", "turn", found.alias("pattern")).where("pattern IS NOT NULL").withColumn("severity", conflicts.severity(F.col("pattern")))


@query("f38_grounded_summary", "SELECT conv_id, CAST(count(*) AS BIGINT) AS sources, round(avg(least(length(text) / 1000, 1)), 6) AS confidence FROM conversations GROUP BY conv_id")
def grounded_summary(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("sources"), F.round(F.avg(F.least(F.length("text") / 1000, F.lit(1.0))), 6).alias("confidence"))


def version_sql(c: str, i: int) -> str:
    """The i-th number of a version without its suffix, in DuckDB; 0 if the version can't be read."""
    numbers = f"string_split(ltrim(split_part(split_part(trim({c}), '-', 1), '+', 1), 'v'), '.')"
    return f"CASE WHEN len({numbers}) BETWEEN 2 AND 3 AND len([x FOR x IN {numbers} IF try_cast(x AS UINTEGER) IS NULL]) = 0 THEN coalesce(try_cast({numbers}[{i}] AS INT), 0) ELSE 0 END"


@query("f39_semver_change", f"""WITH v AS (SELECT p_partkey AS id, 'v' || p_size % 3 || '.' || p_partkey % 4 || '.' || p_partkey % 5 AS a, p_size % 2 || '.' || p_partkey % 3 || CASE WHEN p_partkey % 7 = 0 THEN '-rc1' WHEN p_partkey % 11 = 0 THEN ' beta' ELSE '.' || p_partkey % 5 END AS b, p_size = 50 AS breaking, p_size > 45 AS security FROM part),
c AS (SELECT *, CASE WHEN breaking THEN 'breaking' WHEN {version_sql("a", 1)} <> {version_sql("b", 1)} THEN 'major' WHEN {version_sql("a", 2)} <> {version_sql("b", 2)} THEN 'minor' WHEN {version_sql("a", 3)} <> {version_sql("b", 3)} THEN 'patch' ELSE 'unknown' END AS change FROM v)
SELECT id, change, CAST(CASE WHEN security THEN least(u + 0.3, 1) ELSE u END AS DOUBLE) AS urgency FROM (SELECT *, CASE change WHEN 'breaking' THEN 0.80 WHEN 'major' THEN 0.65 WHEN 'minor' THEN 0.40 WHEN 'patch' THEN 0.20 ELSE 0.30 END AS u FROM c)""")
def semver_change(spark, d):
    """Versions are put together from the keys and sizes of parts; some can't be read."""
    key, size = F.col("p_partkey"), F.col("p_size")
    a = F.concat(F.lit("v"), size % 3, F.lit("."), key % 4, F.lit("."), key % 5)
    b = F.concat(size % 2, F.lit("."), key % 3, F.when(key % 7 == 0, "-rc1").when(key % 11 == 0, " beta").otherwise(F.concat(F.lit("."), key % 5)))
    change = table(spark, d, "part").select(key.alias("id"), text.version_change(a, b, size == 50).alias("change"), (size > 45).alias("security"))
    return change.select("id", "change", text.upgrade_urgency(F.col("change"), F.col("security"), F.lit(False)).alias("urgency"))


@query("f40_heading_lines", r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, last_value(CASE WHEN length(line) < 60 AND line <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading FROM l""")
def heading_lines(spark, d):
    l = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("p", "line"))  # noqa: E741
    w = Window.partitionBy("conv_id", "turn").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return l.select("conv_id", "turn", (F.col("p") + 1).alias("pos"), F.last(F.when((F.length("line") < 60) & (F.col("line") != ""), F.col("line")), True).over(w).alias("heading"))


@query("f41_breaking_changes", r"SELECT page_id, CASE WHEN regexp_matches(html, '(?i)removed|deprecat') THEN 'high' WHEN regexp_matches(html, '&amp;') THEN 'medium' ELSE 'low' END AS impact FROM pages")
def breaking_changes(spark, d):
    return table(spark, d, "pages").select("page_id", F.when(F.col("html").rlike("(?i)removed|deprecat"), "high").when(F.col("html").rlike("&amp;"), "medium").otherwise("low").alias("impact"))


@query("f43_repo_health", "SELECT s_suppkey AS repo, round(0.30 * exp(-(s_suppkey % 400) / 120.0) + 0.25 * least(ln(1 + greatest(s_acctbal, 0)) / ln(1 + 10000.0), 1) + 0.20 * (1 - least(s_nationkey / 20.0, 1) * 0.7) + 0.15 * CASE WHEN s_nationkey % 2 = 0 THEN 0.6 ELSE 0.4 END + 0.10, 3) AS health FROM supplier")
def repo_health(spark, d):
    h = rules.repo_health(F.col("s_suppkey") % 400, F.greatest("s_acctbal", F.lit(0.0)), F.col("s_nationkey"), F.when(F.col("s_nationkey") % 2 == 0, 0.6).otherwise(0.4), F.lit(True))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("repo"), F.round(h, 3).alias("health"))


@query("f45_table_values", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^|\n]+\|')) AS BIGINT) AS cells FROM documents WHERE contains(text, '|')")
def table_values(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("|"))).select("doc_id", F.regexp_count("text", F.lit(r"[^|\n]+\|")).cast("long").alias("cells"))


@query("f46_paper_novelty", r"SELECT doc_id, round(0.4 * least(len(regexp_extract_all(lower(text), '(?:^|[^a-z])(?:novel|new|the)(?:[^a-z]|$)')) / 10, 1) + 0.25 * least(len(regexp_extract_all(lower(text), '(?:^|[^a-z])(?:propose|and)(?:[^a-z]|$)')) / 10, 1), 6) AS novelty FROM documents")
def paper_novelty(spark, d):
    hits = lambda p: F.least(F.regexp_count(F.lower("text"), F.lit(p)) / 10, F.lit(1.0))
    return table(spark, d, "documents").select("doc_id", F.round(0.4 * hits(r"(?:^|[^a-z])(?:novel|new|the)(?:[^a-z]|$)") + 0.25 * hits(r"(?:^|[^a-z])(?:propose|and)(?:[^a-z]|$)"), 6).alias("novelty"))


@query("f47_speaker_turns", "SELECT conv_id, turn, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS speaker_turn FROM (SELECT conv_id, turn, role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS changed FROM conversations)")
def speaker_turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("changed", F.when(F.col("role") != F.lag("role").over(w), 1).otherwise(0))
    return c.select("conv_id", "turn", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("speaker_turn"))


@query("f48_calibration", "SELECT event_id, round(1 / (1 + exp(-ln(p / (1 - p)) / 1.5)), 8) AS temperature, round(1 / (1 + exp(-(0.8 * ln(p / (1 - p)) + 0.1))), 8) AS platt FROM (SELECT event_id, least(greatest(value / 50, 1e-7), 1 - 1e-7) AS p FROM events)")
def calibration(spark, d):
    z = scores.logit(F.col("value") / 50)
    return table(spark, d, "events").select("event_id", F.round(scores.sigmoid(z / 1.5), 8).alias("temperature"), F.round(scores.sigmoid(0.8 * z + 0.1), 8).alias("platt"))


@query("f49_federated_blend", "SELECT user_id, round(a * t + (1 - a) * 1.5, 8) AS temperature FROM (SELECT user_id, least(0.7, 0.7 * count(*) / 50) AS a, 1 + avg(value) / 20 AS t FROM events GROUP BY user_id)")
def federated_blend(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.least(F.lit(0.7), 0.7 * F.count("*") / 50).alias("a"), (1 + F.avg("value") / 20).alias("t"))
    return g.select("user_id", F.round(F.col("a") * F.col("t") + (1 - F.col("a")) * 1.5, 8).alias("temperature"))


@query("f50_hash_chain", """WITH RECURSIVE e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events), f AS (SELECT event_id, user_id, n, sha256('' || event_id) AS h FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, sha256(f.h || e.event_id) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, h AS hash FROM f""")
def hash_chain(spark, d):
    import hashlib

    from ..operators.folds import ordered_fold

    def step(tip, row):
        tip = hashlib.sha256(f"{tip}{row['event_id']}".encode()).hexdigest()
        return tip, {"hash": tip}

    e = table(spark, d, "events").select("user_id", F.unix_micros("ts").alias("at"), "event_id")
    return ordered_fold(e, ["user_id"], ["at", "event_id"], str, step, "hash string").select("event_id", "hash")


@query("f51_utc", "SELECT event_id, ts - INTERVAL 5 HOUR AS utc FROM events")
def utc(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("ts - INTERVAL 5 HOURS").alias("utc"))


@query("f52_url_parameter", r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def url_parameter(spark, d):
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("url", "[?&]page=([^&#]*)", 1), F.lit("")).alias("page"))


@query("f53_token_cost", "SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, round(ceil(length(text) / 4) * 0.00003, 8) AS cost FROM conversations")
def token_cost(spark, d):
    n = F.ceil(F.length("text") / 4)
    return table(spark, d, "conversations").select("conv_id", "turn", n.alias("tokens"), F.round(n * 0.00003, 8).alias("cost"))


@query("f54_validators", r"SELECT event_id, regexp_matches(props, '^\{.*\}$') AS json_like, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AS has_key FROM events")
def validators(spark, d):
    return table(spark, d, "events").select("event_id", F.col("props").rlike(r"^\{.*\}$").alias("json_like"), F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").isNotNull().alias("has_key"))


@query("f55_ucb1", "SELECT l_suppkey AS arm, round(rate + sqrt(2 * ln(sum(n) OVER ()) / n), 6) AS score FROM (SELECT l_suppkey, count(*) AS n, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS rate FROM lineitem GROUP BY l_suppkey)")
def ucb1(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("arm")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("rate"))
    both = g.join(F.broadcast(g.agg(F.sum("n").alias("total"))))
    return both.select("arm", F.round(scores.ucb1(F.col("rate"), F.col("n"), F.col("total")), 6).alias("score"))


@query("f42_changelog_normalise", r"SELECT item_id, CASE WHEN regexp_matches(text, '(^|\n)#+ ') THEN 'headings' WHEN contains(text, chr(10)) THEN 'free' ELSE 'single' END AS form FROM benchmark")
def changelog_normalise(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", F.when(t.rlike(r"(^|\n)#+ "), "headings").when(F.contains(t, F.lit("\n")), "free").otherwise("single").alias("form"))


@query("f44_section_segments")
def section_segments(spark, d):
    """Paragraphs of a document in sections of at least 100 characters; short ones join the section before."""
    from ..operators.folds import ordered_fold

    def step(state, row):
        section, size = state
        if size >= 100:
            section, size = section + 1, 0
        return (section, size + len(row["part"])), {"section": section}

    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "part"))
    return ordered_fold(parts, ["doc_id"], ["place"], lambda: (0, 0), step, "section long").groupBy("doc_id", "section").agg(F.sum(F.length("part")).alias("chars"))
