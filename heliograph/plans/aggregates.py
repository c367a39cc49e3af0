"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from ..operators import relational
from .registry import SIGNALS, query, signals, table


@query("ag01_signal_stats", f"SELECT CAST(count(*) AS BIGINT) AS total, count(*) FILTER (status = 'NEW') AS new, count(*) FILTER (status = 'IN_PROGRESS') AS in_progress, count(*) FILTER (status = 'ACTED') AS acted, count(*) FILTER (created_at < TIMESTAMP '1996-01-01') AS expired, round(avg(action_score), 6) AS avg_score FROM ({SIGNALS})")
def signal_stats(spark, d):
    n = lambda s: F.count_if(F.col("status") == s)
    return signals(spark, d).agg(F.count("*").alias("total"), n("NEW").alias("new"), n("IN_PROGRESS").alias("in_progress"), n("ACTED").alias("acted"), F.count_if(F.col("created_at") < F.lit("1996-01-01").cast("timestamp")).alias("expired"), F.round(F.avg("action_score"), 6).alias("avg_score"))


@query("ag02_time_to_act", "SELECT round(avg(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9, 4) AS hours FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def time_to_act(spark, d):
    both = table(spark, d, "orders").where("o_orderstatus = 'F'").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.agg(F.round(F.avg(F.unix_micros("l_shipdate") - F.unix_micros("o_orderdate")) / 3.6e9, 4).alias("hours"))


@query("ag03_trending_topics", "SELECT topic, count(*) AS mentions, count(DISTINCT platform) AS platforms, max(ts) AS latest FROM (SELECT unnest([event_type, 'user:' || user_id % 10]) AS topic, event_type AS platform, ts FROM events) GROUP BY topic ORDER BY mentions DESC, latest DESC, topic LIMIT 10")
def trending(spark, d):
    e = table(spark, d, "events").select(F.array("event_type", F.concat(F.lit("user:"), F.col("user_id") % 10)).alias("topics"), F.col("event_type").alias("platform"), "ts")
    return relational.trending_topics(e, "topics", "platform", "ts", 10)


@query("ag04_team_digest", f"SELECT status, signal_type, count(*) AS n, count(*) FILTER (action_score >= 0.8) AS urgent FROM ({SIGNALS}) GROUP BY GROUPING SETS ((status), (signal_type))")
def team_digest(spark, d):
    s = signals(spark, d)
    return s.groupingSets([["status"], ["signal_type"]], "status", "signal_type").agg(F.count("*").alias("n"), F.count_if(F.col("action_score") >= 0.8).alias("urgent"))


@query("ag05_cluster_summary", """SELECT lang AS cluster, arg_min(source, (-n, source)) AS topic, string_agg(source, ',' ORDER BY n DESC, source) FILTER (place <= 10) AS keywords, CAST(count(*) AS BIGINT) AS platforms
 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS place FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)) GROUP BY lang""")
def cluster_summary(spark, d):
    n = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), "source")
    best = F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, 10), lambda s: s["source"])
    return n.groupBy(F.col("lang").alias("cluster")).agg(F.min_by("source", order).alias("topic"), F.concat_ws(",", best).alias("keywords"), F.count("*").alias("platforms"))


@query("ag06_event_merge", "SELECT user_id, round(avg(value), 6) AS trust, min(ts) AS first_seen, max(ts) AS last_seen, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM events GROUP BY user_id")
def event_merge(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("trust"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("sources"))


@query("ag07_importance", """SELECT user_id, round(least(greatest(0.35 * log2(least(n, 10) + 1) / log2(11) + 0.35 * trust + 0.2 * least(kinds, 10) / 10 + 0.1 * least(errors, 10) / 10, 0), 1), 6) AS importance
 FROM (SELECT user_id, count(*) AS n, least(avg(value) / 20, 1) AS trust, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id)""")
def importance(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.least(F.avg("value") / 20, F.lit(1.0)).alias("trust"), F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select("user_id", F.round(scores.importance(F.col("n"), F.col("trust"), F.col("kinds"), F.col("errors")), 6).alias("importance"))


@query("ag08_pipeline_totals", "SELECT count(*) AS processed, count(DISTINCT text) AS events, count(*) - count(DISTINCT text) AS merged FROM documents")
def pipeline_totals(spark, d):
    n = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("processed"), F.count("*").alias("events"), (F.sum("n") - F.count("*")).alias("merged"))


@query("ag09_audit_summary", "SELECT event_type, CASE WHEN value >= 15 THEN 'high' WHEN value >= 5 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n, count(*) FILTER (value < 1) AS failures FROM events GROUP BY GROUPING SETS ((1), (2), ())")
def audit_summary(spark, d):
    risk = F.when(F.col("value") >= 15, "high").when(F.col("value") >= 5, "medium").otherwise("low")
    return table(spark, d, "events").withColumn("risk", risk).groupingSets([["event_type"], ["risk"], []], "event_type", "risk").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 1).alias("failures"))


REQUIRED = ["en", "de", "fr", "es", "it"]


@query("ag10_coverage_score", f"""SELECT source, count(*) AS total, count(*) FILTER (n_chars < 200) AS stale, round(len(list_intersect(list(DISTINCT lang), {REQUIRED})) / {float(len(REQUIRED))}, 6) AS completeness,
 array_to_string([x FOR x IN {REQUIRED} IF NOT list_contains(list(DISTINCT lang), x)], ',') AS gaps FROM documents GROUP BY source""")
def coverage_score(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") < 200).alias("stale"), F.collect_set("lang").alias("seen"))
    want = F.array(*map(F.lit, REQUIRED))
    return g.select("source", "total", "stale", F.round(F.size(F.array_intersect(want, "seen")) / float(len(REQUIRED)), 6).alias("completeness"), F.concat_ws(",", F.array_except(want, "seen")).alias("gaps"))


@query("ag11_node_coverage", """SELECT user_id, round(len(list_intersect(fresh, ['click', 'view', 'error'])) / 3.0, 6) AS score, array_to_string([x FOR x IN ['click', 'view', 'error'] IF list_contains(old, x) AND NOT list_contains(fresh, x)], ',') AS stale, array_to_string([x FOR x IN ['click', 'view', 'error'] IF NOT list_contains(old, x)], ',') AS missing
 FROM (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (ts >= TIMESTAMP '2024-01-15'), []) AS fresh, list(DISTINCT event_type) AS old FROM events GROUP BY user_id)""")
def node_coverage(spark, d):
    want = F.array(F.lit("click"), F.lit("view"), F.lit("error"))
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("ts") >= F.lit("2024-01-15").cast("timestamp"), F.col("event_type"))).alias("fresh"), F.collect_set("event_type").alias("seen"))
    return g.select("user_id", F.round(F.size(F.array_intersect(want, "fresh")) / 3.0, 6).alias("score"), F.concat_ws(",", F.array_except(F.array_intersect(want, "seen"), "fresh")).alias("stale"), F.concat_ws(",", F.array_except(want, "seen")).alias("missing"))


@query("ag12_watchlist_overall", "SELECT round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 8) AS overall, count(*) FILTER (l_discount < 0.02) AS at_risk FROM lineitem")
def watchlist_overall(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice"), 8).alias("overall"), F.count_if(F.col("l_discount") < 0.02).alias("at_risk"))


@query("ag13_coverage_upsert", "SELECT user_id AS node, event_type AS source, max(ts) AS last_seen, count(*) AS observations FROM events GROUP BY ALL")
def coverage_upsert(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("node"), F.col("event_type").alias("source")).agg(F.max("ts").alias("last_seen"), F.count("*").alias("observations"))


@query("ag14_scorecard", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM r WHERE n <= 100)
SELECT user_id, round(f.success, 6) AS success, p95 FROM (SELECT user_id, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS success FROM r WHERE n <= 200 GROUP BY user_id) f JOIN (SELECT user_id, value AS p95 FROM l WHERE k = greatest(CAST(ceil(0.95 * c) AS BIGINT), 1)) USING (user_id)""")
def scorecard(spark, d):
    last = relational.top_per_group(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 200, "n")
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN n <= 100 THEN value END)")
    return last.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)), 6).alias("success"), p95.alias("p95"))


def nearest(name, table_name, key, value, pcts):
    sql = f"SELECT {key}, " + ", ".join(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value}) AS p{p}" for p in pcts) + f" FROM {table_name} GROUP BY {key}"

    @query(name, sql)
    def run(spark, d):
        return relational.nearest_rank(table(spark, d, table_name), [key], value, pcts)

    return run


nearest("ag15_nearest_rank", "events", "event_type", "value", [95])
nearest("ag16_slo_percentiles", "lineitem", "l_returnflag", "l_extendedprice", [50, 95, 99])


@query("ag17_interpolated_percentile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def interpolated(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("ag18_health_report", """SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, CASE WHEN quantile_cont(value, 0.95) > 20 THEN 'critical' WHEN quantile_cont(value, 0.95) > 10 THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY event_type""")
def health_report(spark, d):
    p = lambda x: F.percentile("value", x)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(*(F.round(p(x), 6).alias(n) for n, x in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))), F.round(F.avg("value"), 6).alias("mean"), F.when(p(0.95) > 20, "critical").when(p(0.95) > 10, "degraded").otherwise("healthy").alias("status"))


@query("ag19_gap_severities", f"SELECT severity, count(s.id) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) AS v(severity) LEFT JOIN (SELECT id, CASE WHEN action_score >= 0.9 THEN 'high' WHEN action_score >= 0.5 THEN 'medium' ELSE 'low' END AS sev FROM ({SIGNALS})) s ON s.sev = severity GROUP BY severity")
def gap_severities(spark, d):
    sev = F.when(F.col("action_score") >= 0.9, "high").when(F.col("action_score") >= 0.5, "medium").otherwise("low")
    counted = signals(spark, d).groupBy(sev.alias("severity")).agg(F.count("*").alias("c"))
    every = spark.createDataFrame([("critical",), ("high",), ("medium",), ("low",)], "severity string")
    return every.join(counted, "severity", "left").select("severity", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


@query("ag20_deep_dive", "SELECT conv_id, string_agg(role, ',' ORDER BY pos) AS roles, round(avg(len), 4) AS mean_len FROM (SELECT conv_id, role, min(turn) AS pos, avg(length(text)) AS len FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def deep_dive(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("pos"), F.avg(F.length("text")).alias("len"))
    roles = F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda s: s["role"])
    return g.groupBy("conv_id").agg(F.concat_ws(",", roles).alias("roles"), F.round(F.avg("len"), 4).alias("mean_len"))


@query("ag21_label_vote", """WITH v AS (SELECT user_id, event_type AS label, sum(value / 20) / max(total) AS score FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM events) GROUP BY ALL)
SELECT user_id, CASE WHEN max(score) < 0.3 THEN 'abstain' ELSE arg_max(label, (score, label)) END AS label FROM v GROUP BY user_id""")
def label_vote(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum(F.col("value") / 20).alias("s"), F.count("*").alias("c"))
    v = g.withColumn("score", F.col("s") / F.sum("c").over(Window.partitionBy("user_id")))
    return v.groupBy("user_id").agg(F.when(F.max("score") < 0.3, "abstain").otherwise(F.max_by("event_type", F.struct("score", "event_type"))).alias("label"))


@query("ag22_history_distribution", """WITH n AS (SELECT q.vec_id AS query_id, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS k FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
SELECT query_id, label, count(*) AS n FROM n WHERE k <= 5 GROUP BY ALL""")
def history_distribution(spark, d):
    from ..operators.vectors import knn

    e = table(spark, d, "embeddings")
    near = knn(e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 5)
    return near.join(e.select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))


@query("ag23_type_weights", "SELECT user_id, event_type, round(greatest(0.05, 1 - 0.95 * count(*) FILTER (value < 5) / count(*)), 6) AS weight FROM events GROUP BY ALL")
def type_weights(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.greatest(F.lit(0.05), 1 - 0.95 * F.count_if(F.col("value") < 5) / F.count("*")), 6).alias("weight"))


@query("ag24_false_positive_rate", "SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50 GROUP BY user_id")
def false_positive_rate(spark, d):
    last = relational.top_per_group(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50, "n")
    return last.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), 6).alias("rate"))


@query("ag25_approval_rate", "SELECT c_custkey AS user_id, coalesce(rate, 0.0) AS rate FROM customer LEFT JOIN (SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY user_id) e ON e.user_id = c_custkey")
def approval_rate(spark, d):
    r = table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).groupBy("user_id").agg(F.round(F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)), 6).alias("rate"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(r, "user_id", "left").select("user_id", F.coalesce("rate", F.lit(0.0)).alias("rate"))


@query("ag26_feedback_summary", "SELECT event_type, count(*) AS n, count(*) FILTER (value >= 10) AS positive, count(*) FILTER (value < 10) AS negative FROM events GROUP BY event_type")
def feedback_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 10).alias("positive"), F.count_if(F.col("value") < 10).alias("negative"))


@query("ag27_dataset_report", r"SELECT count(*) AS n, count(*) - count(DISTINCT doc_id) AS duplicate_ids, round(avg(n_chars), 4) AS avg_chars, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS with_email FROM documents")
def dataset_report(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("doc_id")).alias("duplicate_ids"), F.round(F.avg("n_chars"), 4).alias("avg_chars"), F.count_if(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).alias("with_email"))


@query("ag28_class_balance", "SELECT count(*) AS classes, round(max(n) / min(n), 6) AS ratio, round(sum(hard) / sum(n), 6) AS hard_rate FROM (SELECT quality, toxic, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS hard FROM labels GROUP BY ALL)")
def class_balance(spark, d):
    g = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("hard"))
    return g.agg(F.count("*").alias("classes"), F.round(F.max("n") / F.min("n"), 6).alias("ratio"), F.round(F.sum("hard") / F.sum("n"), 6).alias("hard_rate"))


@query("ag29_exemplars_per_type", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def exemplars_per_type(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("ag30_queue_stats", f"SELECT signal_type, status, count(*) AS n FROM ({SIGNALS}) GROUP BY GROUPING SETS ((signal_type), (status))")
def queue_stats(spark, d):
    return signals(spark, d).groupingSets([["signal_type"], ["status"]], "signal_type", "status").agg(F.count("*").alias("n"))


@query("ag31_bandit_stats", """SELECT arm, n, round(rate, 6) AS rate, row_number() OVER (ORDER BY rate DESC, n DESC, arm DESC) = 1 AS best
 FROM (SELECT l_returnflag AS arm, count(*) AS n, avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END) AS rate FROM lineitem GROUP BY ALL)""")
def bandit_stats(spark, d):
    """Pulls and success rate of each arm, and which is best: of equal rates, the one pulled more often."""
    reward = F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)
    arms = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.count("*").alias("n"), F.avg(reward).alias("rate"))
    place = F.row_number().over(Window.orderBy(F.desc("rate"), F.desc("n"), F.desc("arm")))  # one row an arm
    return arms.select("arm", "n", F.round("rate", 6).alias("rate"), (place == 1).alias("best"))


@query("ag32_ingestion_metrics", "SELECT source AS platform, count(*) AS items, round(avg(n_chars), 4) AS avg_chars, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def ingestion_metrics(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("platform")).agg(F.count("*").alias("items"), F.round(F.avg("n_chars"), 4).alias("avg_chars"), F.sum("n_chars").alias("chars"))


@query("ag33_influence", "SELECT l_partkey AS dst, count(DISTINCT l_orderkey) AS influence FROM lineitem GROUP BY l_partkey")
def influence(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("dst")).agg(F.countDistinct("l_orderkey").alias("influence"))


@query("ag34_distinct_ids", "SELECT DISTINCT user_id FROM events ORDER BY user_id")
def distinct_ids(spark, d):
    return table(spark, d, "events").select("user_id").distinct().orderBy("user_id")


@query("ag35_suspicious_patterns", """SELECT event_type AS tenant, count(*) FILTER (value < 2) >= 5 AS permission_changes, count(*) FILTER (value > 15) >= 3 AS critical, count(DISTINCT user_id) > greatest(3, 100 // 5) AS many_actors FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100 GROUP BY event_type""")
def suspicious_patterns(spark, d):
    last = relational.top_per_group(table(spark, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 100, "n")
    return last.groupBy(F.col("event_type").alias("tenant")).agg((F.count_if(F.col("value") < 2) >= 5).alias("permission_changes"), (F.count_if(F.col("value") > 15) >= 3).alias("critical"), (F.countDistinct("user_id") > 20).alias("many_actors"))


@query("ag36_over_reliance", "SELECT source, round(d / n, 6) AS ratio FROM (SELECT source, count(*) AS n, count(*) FILTER (lang <> 'en') AS d FROM documents GROUP BY source) WHERE d / n >= 0.3 ORDER BY ratio DESC, source")
def over_reliance(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") != "en").alias("d"))
    return g.where(F.col("d") / F.col("n") >= 0.3).select("source", F.round(F.col("d") / F.col("n"), 6).alias("ratio")).orderBy(F.desc("ratio"), "source")


@query("ag37_slo_violations", """WITH m AS (SELECT source, avg(CASE WHEN n_chars >= 100 THEN 1.0 ELSE 0.0 END) AS parse, max(n_chars) AS latency, count(*) AS items FROM documents GROUP BY source)
SELECT source, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT source, CAST(parse AS DOUBLE) AS parse, CAST(latency AS DOUBLE) AS latency, CAST(items AS DOUBLE) AS items FROM m) ON parse, latency, items INTO NAME metric VALUE value) WHERE (metric = 'parse' AND value < 0.95) OR (metric = 'latency' AND value > 20000) OR (metric = 'items' AND value < 10)""")
def slo_violations(spark, d):
    m = table(spark, d, "documents").groupBy("source").agg(F.avg(F.when(F.col("n_chars") >= 100, 1.0).otherwise(0.0)).alias("parse"), F.max("n_chars").cast("double").alias("latency"), F.count("*").cast("double").alias("items"))
    long = m.unpivot(["source"], ["parse", "latency", "items"], "metric", "value")
    return long.where("(metric = 'parse' AND value < 0.95) OR (metric = 'latency' AND value > 20000) OR (metric = 'items' AND value < 10)").withColumn("value", F.round("value", 6))


@query("ag38_request_metrics", "SELECT event_type AS provider, CAST(least(floor(value / 5), 10) AS BIGINT) AS bucket, count(*) AS requests, round(sum(value), 4) AS cost FROM events GROUP BY ALL")
def request_metrics(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("provider"), F.least(F.floor(F.col("value") / 5), F.lit(10)).cast("long").alias("bucket")).agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("cost"))


@query("ag39_rollup_cube", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_cube(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
