"""Window-like operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from ..operators import relational
from ..operators.folds import ordered_fold
from .registry import query, table

DAY = 86_400


def by_time(*keys):
    return Window.partitionBy(*keys).orderBy("at", "event_id")


def events(spark, d):
    return table(spark, d, "events").withColumn("at", F.unix_micros("ts"))


@query("w01_trending_score", """WITH c AS (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS day, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS week FROM events)
SELECT event_id, round(CASE WHEN week < 5 THEN 0 ELSE day / (3 * week / 7) END, 6) AS score FROM c""")
def trending_score(spark, d):
    spans = {"day": DAY * 1_000_000, "week": 7 * DAY * 1_000_000}
    e = relational.trailing_counts(events(spark, d).select("event_id", "event_type", "at"), ["event_type"], "at", spans, 3600 * 1_000_000)
    return e.select("event_id", F.round(F.when(F.col("week") < 5, 0.0).otherwise(F.col("day") / (3 * F.col("week") / 7)), 6).alias("score"))


@query("w02_trending_types", """SELECT event_type, round(CASE WHEN week < 5 THEN 0 ELSE day / (3 * week / 7) END, 6) AS score FROM (SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-19') AS day, count(*) FILTER (ts >= TIMESTAMP '2024-01-13') AS week FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY event_type)""")
def trending_types(spark, d):
    since = lambda s: F.count_if(F.col("ts") >= F.lit(s).cast("timestamp"))
    g = events(spark, d).where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp")).groupBy("event_type").agg(since("2024-01-19").alias("day"), since("2024-01-13").alias("week"))
    return g.select("event_type", F.round(F.when(F.col("week") < 5, 0.0).otherwise(F.col("day") / (3 * F.col("week") / 7)), 6).alias("score"))


@query("w03_fingerprint_window")
def fingerprint_window(spark, d):
    """Kept unless a kept event of the same user and type came less than 24 hours before."""

    def step(kept, row):
        again = kept is not None and row["at"] - kept < DAY * 1_000_000
        return (kept if again else row["at"]), {"kept": not again}

    return ordered_fold(events(spark, d).select("user_id", "event_type", "at", "event_id"), ["user_id", "event_type"], ["at", "event_id"], lambda: None, step, "kept boolean")


@query("w04_novelty", """WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events)
SELECT a.event_id, round(greatest(0.05, coalesce(1 - sum(pow(0.9, a.n - b.n - 1) * CASE WHEN a.event_type = b.event_type THEN 1 ELSE 0 END) / sum(pow(0.9, a.n - b.n - 1)), 1)), 6) AS novelty FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 50 AND a.n - 1 GROUP BY a.event_id""")
def novelty(spark, d):
    """Share of the decayed history of 50 that differs; the history is a frame of 50 rows, not a join."""
    w = by_time("user_id").rowsBetween(-50, -1)
    history = F.reverse(F.collect_list("event_type").over(w))
    weights = F.transform(F.col("h"), lambda x, i: F.pow(F.lit(0.9), i))
    same = F.transform(F.col("h"), lambda x, i: F.when(x == F.col("event_type"), F.pow(F.lit(0.9), i)).otherwise(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return events(spark, d).withColumn("h", history).select("event_id", F.round(F.greatest(F.lit(0.05), F.when(F.size("h") == 0, 1.0).otherwise(1 - total(same) / total(weights))), 6).alias("novelty"))


def ema(alpha, start):
    """An exponential moving average as a fold over values."""

    def step(state, row):
        value = row["value"] if state is None and start is None else (start if state is None else state) * (1 - alpha) + alpha * row["value"]
        return value, {"ema": value}

    return step


EMA_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
f AS (SELECT event_id, user_id, n, {first} AS ema FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, f.ema * {keep} + {alpha} * e.value FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, round({out}, 6) AS {name} FROM f"""


@query("w05_topic_centroid", EMA_SQL.format(first="value", keep="0.8", alpha="0.2", out="ema", name="centroid"))
def topic_centroid(spark, d):
    e = events(spark, d).select("user_id", "at", "event_id", "value")
    return ordered_fold(e, ["user_id"], ["at", "event_id"], lambda: None, ema(0.2, None), "ema double").select("event_id", F.round("ema", 6).alias("centroid"))


@query("w06_crawl_interval", EMA_SQL.format(first="0.5 * 0.7 + 0.3 * value", keep="0.7", alpha="0.3", out="least(greatest(60 / greatest(0.01, ema / 20), 5), 1440)", name="minutes"))
def crawl_interval(spark, d):
    e = events(spark, d).select("user_id", "at", "event_id", "value")
    out = ordered_fold(e, ["user_id"], ["at", "event_id"], lambda: None, ema(0.3, 0.5), "ema double")
    return out.select("event_id", F.round(scores.clamp(60 / F.greatest(F.lit(0.01), F.col("ema") / 20), 5.0, 1440.0), 6).alias("minutes"))


@query("w07_overdue_sources", "SELECT source, last + INTERVAL 60 MINUTE < TIMESTAMP '2024-01-25' AS overdue FROM (SELECT event_type AS source, max(ts) AS last FROM events GROUP BY event_type)")
def overdue_sources(spark, d):
    g = events(spark, d).groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last"))
    return g.select("source", F.expr("last + INTERVAL 60 MINUTE < TIMESTAMP '2024-01-25'").alias("overdue"))


@query("w08_sentiment_drift", """WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
f AS (SELECT event_id, user_id, n, CAST(0 AS DOUBLE) AS drift, value AS base FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, least(greatest(e.value - f.base, -1), 1), 0.8 * f.base + 0.2 * e.value FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, round(drift, 6) AS drift FROM f""")
def sentiment_drift(spark, d):
    def step(base, row):
        if base is None:
            return row["value"], {"drift": 0.0}
        return 0.8 * base + 0.2 * row["value"], {"drift": max(-1.0, min(1.0, row["value"] - base))}

    e = events(spark, d).select("user_id", "at", "event_id", "value")
    return ordered_fold(e, ["user_id"], ["at", "event_id"], lambda: None, step, "drift double").select("event_id", F.round("drift", 6).alias("drift"))


@query("w09_slo_window", """WITH m AS (SELECT event_id, user_id, event_type, ts, avg(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) > 12 AS breach FROM events)
SELECT event_id, breach FROM m""")
def slo_window(spark, d):
    w = Window.partitionBy("event_type").orderBy("at").rangeBetween(-3600 * 1_000_000, 0)
    return events(spark, d).select("event_id", (F.avg("value").over(w) > 12).alias("breach"))


@query("w10_sliding_chunks", """SELECT doc_id, CAST(i // 700 AS BIGINT) AS chunk, substr(text, CAST(i + 1 AS BIGINT), 800) AS body FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 700)) AS i FROM documents)""")
def sliding_chunks(spark, d):
    i = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(700)))
    return table(spark, d, "documents").select("doc_id", "text", i.alias("i")).select("doc_id", F.floor(F.col("i") / 700).alias("chunk"), F.substr("text", F.col("i") + 1, F.lit(800)).alias("body"))


@query("w11_block_window", """SELECT conv_id, block, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT conv_id, turn, role, unnest([b for b in [turn // 5, turn // 5 - 1] if b >= 0]) AS block FROM conversations) GROUP BY conv_id, block""")
def block_window(spark, d):
    own = F.floor(F.col("turn") / 5)
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.explode(F.filter(F.array(own, own - 1), lambda b: b >= 0)).alias("block"))
    return c.groupBy("conv_id", "block").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])).alias("roles"))


@query("w12_growth_per_hour", "SELECT user_id, round((arg_max(value, (epoch_us(ts), event_id)) - arg_min(value, (epoch_us(ts), event_id))) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 0), 6) AS growth FROM events GROUP BY user_id")
def growth_per_hour(spark, d):
    key = F.struct("at", "event_id")
    hours = F.nullif((F.max("at") - F.min("at")) / 3.6e9, F.lit(0.0))
    return events(spark, d).groupBy("user_id").agg(F.round((F.max_by("value", key) - F.min_by("value", key)) / hours, 6).alias("growth"))


@query("w13_embedding_drift", """SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(before AS DOUBLE[])), 5) AS drift FROM (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings) WHERE before IS NOT NULL""")
def embedding_drift(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, d, "embeddings").withColumn("before", F.lag("embedding").over(w)).where("before IS NOT NULL")
    return e.select("vec_id", F.round(1 - scores.cosine(F.col("embedding"), F.col("before")), 5).alias("drift"))


@query("w14_alpha_controller")
def alpha_controller(spark, d):
    """The novelty share: up by .02 for a click, down by .02 for an error, within [.05, .95]."""

    def step(alpha, row):
        alpha = min(0.95, max(0.05, alpha + {"click": 0.02, "error": -0.02}.get(row["event_type"], 0.0)))
        return alpha, {"alpha": alpha}

    e = events(spark, d).select("user_id", "at", "event_id", "event_type")
    return ordered_fold(e, ["user_id"], ["at", "event_id"], lambda: 0.5, step, "alpha double").select("event_id", F.round("alpha", 6).alias("alpha"))


@query("w15_interest_decay", "SELECT user_id, event_type AS topic, round(least(count(*) / 10, 1), 6) AS confidence, round(avg(value) / 20 * pow(0.95, date_diff('day', max(ts), TIMESTAMP '2024-03-01')), 6) AS weight FROM events GROUP BY ALL")
def interest_decay(spark, d):
    days = F.expr("datediff(TIMESTAMP '2024-03-01', max(ts))")
    return events(spark, d).groupBy("user_id", F.col("event_type").alias("topic")).agg(F.round(F.least(F.count("*") / 10, F.lit(1.0)), 6).alias("confidence"), F.round(F.avg("value") / 20 * F.pow(F.lit(0.95), days), 6).alias("weight"))


@query("w16_negation_lookback", r"""WITH t AS (SELECT conv_id, turn, [w FOR w IN regexp_split_to_array(lower(text), '\s+') IF w <> ''] AS ws FROM conversations), p AS (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS i FROM t WHERE len(ws) > 0)
SELECT conv_id, turn, CAST(sum(CASE WHEN ws[i] IN ('the', 'la', 'die') THEN CASE WHEN list_has_any(ws[greatest(i - 3, 1):i - 1], ['of', 'de', 'und']) THEN -1 ELSE 1 END ELSE 0 END) AS BIGINT) AS valence FROM p GROUP BY ALL""")
def negation_lookback(spark, d):
    """Hits count 1, or -1 with a negator among the three words before."""
    hits, negators = (F.array(*map(F.lit, x)) for x in (("the", "la", "die"), ("of", "de", "und")))
    ws = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    value = F.transform(F.col("ws"), lambda w, i: F.when(~F.array_contains(hits, w), 0).when((i > 0) & F.arrays_overlap(F.slice("ws", F.greatest(i - 2, F.lit(1)), F.when(i > 0, F.least(i, F.lit(3))).otherwise(1)), negators), -1).otherwise(1))
    t = table(spark, d, "conversations").select("conv_id", "turn", ws.alias("ws")).where(F.size("ws") > 0)
    return t.select("conv_id", "turn", F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + x).alias("valence"))


@query("w17_rate_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS in_minute FROM events")
def rate_window(spark, d):
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-60_000_000, 0)
    return events(spark, d).select("event_id", F.count("*").over(w).alias("in_minute"))


@query("w18_rolling_history", "SELECT event_id FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20 AND ts >= TIMESTAMP '2024-01-10'")
def rolling_history(spark, d):
    return relational.top_per_group(events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20, "n").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")).select("event_id")


RUNS_SQL = """WITH f AS (SELECT event_id, user_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING) AS island, epoch_us(ts) AS tm FROM events),
r AS (SELECT event_id, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)"""


@query("w19_backoff", RUNS_SQL + " SELECT event_id, CAST(CASE WHEN run = 0 THEN 0 ELSE least(60 * pow(2, run - 1), 3600) END AS DOUBLE) AS seconds FROM r")
def backoff(spark, d):
    e = relational.runs(events(spark, d), ["user_id"], ["at", "event_id"], F.col("event_type") == "error")
    return e.select("event_id", F.when(F.col("run") == 0, 0.0).otherwise(F.least(60 * F.pow(F.lit(2.0), F.col("run") - 1), F.lit(3600.0))).alias("seconds"))


@query("w20_circuit_open", RUNS_SQL + " SELECT event_id, run >= 3 AS open FROM r")
def circuit_open(spark, d):
    return relational.runs(events(spark, d), ["user_id"], ["at", "event_id"], F.col("event_type") == "error").select("event_id", (F.col("run") >= 3).alias("open"))


@query("w21_cursor_changes", """SELECT event_id, before, value AS after FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS before, event_type FROM events) WHERE event_type = 'purchase' AND (before IS NULL OR before <> value)""")
def cursor_changes(spark, d):
    e = events(spark, d).withColumn("before", F.lag("value").over(by_time("user_id")))
    return e.where((F.col("event_type") == "purchase") & (F.col("before").isNull() | (F.col("before") != F.col("value")))).select("event_id", "before", F.col("value").alias("after"))
