"""Streams, each run over what its folder holds and read back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stateful, streams, workflows
from ..operators.state import shared_dir
from .registry import SIGNALS, query, signals, table


def drained(spark: SparkSession, d: str, make, mode: str) -> DataFrame:
    """Run a stream over events.parquet to its end; each batch is appended to a table in the shared folder."""
    work = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = streams.read_stream(spark, f"{d}/events.parq[u]et", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = make(source)
    spark.createDataFrame([], out.schema).withColumn("batch", F.lit(0).cast("long")).write.parquet(f"{work}/out")

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{work}/out")

    streams.run_available(out, f"{work}/checkpoint", sink, mode)
    return spark.read.parquet(f"{work}/out")


def last(df: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key of an update stream."""
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


@query("st05_trend_windows", """SELECT event_type, strftime(day - INTERVAL (i) DAY, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) AS day, unnest(range(0, 7)) AS i FROM events) GROUP BY ALL""")
def trend_windows(spark, d):
    out = drained(spark, d, lambda s: streams.trend_counts(s, "event_type", "ts"), "update")
    return last(out, ["window", "event_type"]).select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("start"), "n")


@query("st06_dedup_state")
def dedup_state(spark, d):
    return drained(spark, d, lambda s: streams.dedup_within(s, ["user_id", "event_type"], "ts"), "append").select("user_id", "event_type", "ts")


@query("st07_sessions")
def sessions(spark, d):
    out = drained(spark, d, lambda s: streams.session_counts(s, "user_id", "ts"), "append")
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


@query("st08_online_temperature")
def online_temperature(spark, d):
    def make(s):
        s = s.select("event_type", F.least(F.col("value") / 50, F.lit(1.0)).alias("p"), F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("y"))
        return streams.online_temperature(s, "event_type", "p", "y")

    return last(drained(spark, d, make, "update"), ["event_type"]).select("event_type", "updates")


@query("st13_circuit_state")
def circuit_state(spark, d):
    def make(s):
        return streams.circuit_state(s.select("user_id", (F.col("event_type") == "error").alias("failed"), F.unix_micros("ts").alias("at")), "user_id", "failed")

    return last(drained(spark, d, make, "update"), ["user_id"])


@query("st14_rescore", f"SELECT id, round(action_score * 0.8 / (1 + exp(-ln(p / (1 - p)) / 1.3)), 8) AS score FROM (SELECT *, least(greatest(action_score, 1e-7), 1 - 1e-7) AS p FROM ({SIGNALS})) WHERE status IN ('NEW', 'QUEUED')")
def rescore(spark, d):
    from ..functions import scores

    s = F.col("action_score")
    return signals(spark, d).where(F.col("status").isin("NEW", "QUEUED")).select("id", F.round(s * 0.8 * scores.sigmoid(scores.logit(s) / 1.3), 8).alias("score"))


@query("st18_latest_transition", "SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS state FROM events GROUP BY user_id")
def latest_transition(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct(F.unix_micros("ts"), "event_id")).alias("state"))


@query("st04_thread_expansion", "SELECT c.conv_id, c.turn FROM conversations c WHERE c.turn <= 50 AND EXISTS (SELECT 1 FROM conversations f WHERE f.conv_id = c.conv_id AND f.turn = 0 AND length(f.text) > 100)")
def thread_expansion(spark, d):
    c = table(spark, d, "conversations")
    seeds = c.where("turn = 0 AND length(text) > 100").select("conv_id")
    return c.where("turn <= 50").join(seeds, "conv_id", "left_semi").select("conv_id", "turn")


@query("st10_threshold_steps")
def threshold_steps(spark, d):
    """The noise threshold of each user: a step of .02 up or down after every five outcomes, within .1 and .9."""
    from ..operators.folds import ordered_fold

    def step(state, row):
        level, bad, n = state
        bad, n = bad + (row["event_type"] == "error"), n + 1
        if n == 5:
            level, bad, n = min(0.9, max(0.1, level + (0.02 if bad >= 2 else -0.02))), 0, 0
        return (level, bad, n), {"threshold": level}

    e = table(spark, d, "events").select("user_id", F.unix_micros("ts").alias("at"), "event_id", "event_type")
    return ordered_fold(e, ["user_id"], ["at", "event_id"], lambda: (0.5, 0, 0), step, "threshold double").select("event_id", F.round("threshold", 6).alias("threshold"))


@query("st12_token_bucket")
def token_bucket(spark, d):
    """Which events a bucket of 5 tokens, refilled by one every ten minutes, lets through."""
    from ..operators.folds import ordered_fold

    def step(state, row):
        tokens, last = state
        tokens = 5.0 if last is None else min(5.0, tokens + (row["at"] - last) / 600e6)
        ok = tokens >= 1
        return (tokens - ok, row["at"]), {"allowed": ok}

    e = table(spark, d, "events").select("user_id", F.unix_micros("ts").alias("at"), "event_id")
    return ordered_fold(e, ["user_id"], ["at", "event_id"], lambda: (5.0, None), step, "allowed boolean").select("event_id", "allowed")


@query("st11_stream_clusters")
def stream_clusters(spark, d):
    """Event clusters as they arrive: a new one for each user and type after an hour of silence."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("at", "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", F.unix_micros("ts").alias("at"), "event_id")
    new = F.when(F.col("at") - F.lag("at").over(w) > 3_600_000_000, 1).otherwise(0)
    return e.withColumn("new", new).select("event_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster"))


@query("st16_chain_tips", "SELECT user_id, count(*) AS length, max(epoch_us(ts)) AS latest FROM events GROUP BY user_id")
def chain_tips(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("length"), F.max(F.unix_micros("ts")).alias("latest"))


@query("st17_workflow", f"""WITH s AS (SELECT id, signal_type, action_score, CAST(substr(signal_type, 1, 1) AS INT) AS urgency FROM ({SIGNALS}) WHERE status = 'NEW'),
t AS (SELECT *, CASE WHEN action_score >= 0.2 THEN round(action_score / urgency, 9) END AS score FROM s)
SELECT id, score, CASE WHEN score > 0.5 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN score > 0.5 THEN 'needs approval' END AS error,
 'analyze:COMPLETED,' || CASE WHEN action_score >= 0.2 THEN 'score:COMPLETED' ELSE 'score:SKIPPED' END || CASE WHEN score > 0.5 THEN ',decide:FAILED' WHEN score IS NULL THEN ',decide:COMPLETED,notify:SKIPPED' ELSE ',decide:COMPLETED,notify:COMPLETED' END AS steps FROM t""")
def workflow(spark, d):
    """New signals through four steps: analyze, score (of those with a high action score), decide (which fails above a limit) and notify."""
    known = workflows.Registry()
    score = F.col("score")
    known.register("triage", [
        workflows.Step("analyze", F.substring("signal_type", 1, 1).cast("int")),
        workflows.Step("score", F.round(F.col("action_score") / F.col("analyze"), 9), F.col("action_score") >= 0.2),
        workflows.Step("decide", F.coalesce(score, F.lit(0.0)) > 0.1, error=F.when(score > 0.5, "needs approval")),
        workflows.Step("notify", F.concat_ws(" ", F.lit("signal"), "id"), score.isNotNull()),
    ])
    ran = known.run("triage", signals(spark, d).where("status = 'NEW'").drop("status"))
    return ran.select("id", "score", "status", "error", F.concat_ws(",", F.transform("steps", lambda s: F.concat_ws(":", s["step"], s["status"]))).alias("steps"))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return streams.read_stream(spark, f"{d}/events.parq[u]et", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def work_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("st07_ring_buffer", """SELECT event_type, CAST(max(seen) AS BIGINT) AS seen, count(*) AS held, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS percentile
FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS seen, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events WHERE value IS NOT NULL) WHERE back <= 1000 GROUP BY event_type""")
def ring_buffer(spark, d):
    """The last 1 000 values of each event type; the operator's own size is 10 000, which small tables don't fill."""
    rings = stateful.ring_buffer(event_stream(spark, d), "event_type", F.col("ts"), F.col("event_id"), F.col("value"), 1000)
    out = stateful.latest(stateful.run_batches(rings, work_folder(spark), "update", state=True), "event_type")
    return out.select("event_type", "seen", "held", F.round("mean", 6).alias("mean"), "percentile")


@query("st16_audit_chain", """WITH RECURSIVE e AS (SELECT user_id, event_id, '{"entry_id": ' || event_id || ', "event_type": "' || event_type || '", "tenant_id": ' || user_id || '}' AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
f AS (SELECT user_id, event_id, seq, sha256('GENESIS' || text) AS hash FROM e WHERE seq = 1 UNION ALL SELECT e.user_id, e.event_id, e.seq, sha256(f.hash || e.text) FROM f JOIN e ON e.user_id = f.user_id AND e.seq = f.seq + 1)
SELECT user_id, seq, event_id, hash, TRUE AS verified FROM f""")
def audit_chain(spark, d):
    """Each tenant's events in a hash chain whose tip is stream state, and whether each entry verifies."""
    text = F.concat(F.lit('{"entry_id": '), "event_id", F.lit(', "event_type": "'), "event_type", F.lit('", "tenant_id": '), "user_id", F.lit("}"))
    chain = stateful.run_batches(stateful.chained(event_stream(spark, d), "user_id", "ts", "event_id", text), work_folder(spark))
    bad = stateful.broken_links(chain, "user_id")
    return chain.join(bad, ["user_id", "seq"], "left").select("user_id", "seq", F.col("id").alias("event_id"), "hash", F.col("wrong").isNull().alias("verified"))


@query("st15_feedback_temperature")
def feedback_temperature(spark, d):
    """Events with the event of the next number as their outcome, if it comes within a day, and the temperature each user and class learns from them."""
    e = event_stream(spark, d)
    views = e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("class"), F.least(F.col("value") / 50, F.lit(1.0)).alias("p"), F.col("ts").alias("at"))
    told = event_stream(spark, d).select((F.col("event_id") - 1).alias("of"), F.col("event_id").alias("outcome_id"), F.col("event_type").isin("click", "purchase").alias("right"), F.col("ts").alias("told"))
    joined = stateful.feedback(views, told, "1 day", "1 day")
    out = stateful.latest(stateful.run_batches(stateful.user_temperatures(joined), work_folder(spark)), "user_id", "class")
    score = stateful.calibrated(F.lit(0.8), F.col("temperature"), F.col("steps"))
    return out.select("user_id", "class", F.round("temperature", 8).alias("temperature"), "steps", F.round(score, 8).alias("calibrated"))


@query("st01_incremental_sources", "SELECT event_type AS source, event_id, user_id, value FROM events")
def incremental_sources(spark, d):
    """Events landed as JSON lines in one folder a source, read by the streaming source with an offset for each."""
    from ..sources.landed import LandedSource

    work = work_folder(spark)
    landed = table(spark, d, "events").select(F.col("event_type").alias("source"), "event_id", "user_id", "value")
    landed.repartition(4, "event_id").write.partitionBy("source").json(f"{work}/landed")
    spark.dataSource.register(LandedSource)
    stream = spark.readStream.format("heliograph_landed").option("path", f"{work}/landed").load()
    item = F.from_json("item", "event_id long, user_id long, value double").alias("i")
    out = stateful.run_batches(stream.select(F.regexp_replace("source", "^source=", "").alias("source"), item).select("source", "i.*"), work)
    return out.select("source", "event_id", "user_id", "value")


@query("st11_event_clusters")
def event_clusters(spark, d):
    """Turns of each conversation as they arrive, joined to the open event clusters; in one run the same as the batch clusters of cl01."""
    from ..functions import text

    schema = spark.read.parquet(f"{d}/conversations.parquet").schema
    stream = streams.read_stream(spark, f"{d}/conversations.parq[u]et", schema)
    names = F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), F.lit(0))
    found = stateful.event_clusters(stream, "conv_id", F.col("turn"), F.col("turn"), text.title_tokens(F.col("text")), names)
    out = stateful.run_batches(found, work_folder(spark), state=True)
    return out.select("conv_id", F.col("id").alias("turn"), "cluster")
