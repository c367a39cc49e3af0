"""Streams with state: several batches, a restart, a batch that runs again."""

import random

import pytest
from pyspark.sql import functions as F

from heliograph.operators import stateful, streams

SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp"


def files(spark, path, rows, parts, first=0):
    for i in range(parts):
        some = rows[len(rows) * i // parts : len(rows) * (i + 1) // parts]
        spark.createDataFrame(some, SCHEMA).selectExpr("event_id", "user_id", "event_type", "value", "timestamp_seconds(unix_timestamp(ts)) AS ts").coalesce(1).write.mode("append").parquet(path)


def events(n, seed):
    import datetime

    rnd, t = random.Random(seed), datetime.datetime(2024, 1, 1)
    return [(i, rnd.randrange(3), rnd.choice(["view", "view", "click"]), rnd.random() * 50, t + datetime.timedelta(seconds=60 * i)) for i in range(n)]


def source(spark, path, schema):
    return streams.read_stream(spark, path, schema, 1)


def test_ring_buffer_over_batches_and_a_restart(spark, tmp_path):
    rows, path, work = events(600, 1), str(tmp_path / "in"), str(tmp_path / "work")
    files(spark, path, rows[:300], 3)
    schema = spark.read.parquet(path).schema
    make = lambda: stateful.ring_buffer(source(spark, path, schema), "user_id", F.col("ts"), F.col("event_id"), F.col("value"), 50)
    stateful.run_batches(make(), work, "update", state=True)
    files(spark, path, rows[300:], 2)
    got = {r["user_id"]: r for r in stateful.latest(stateful.run_batches(make(), work, "update", state=True), "user_id").collect()}
    for user in range(3):
        values = [r[3] for r in rows if r[1] == user]
        last = sorted(values[-50:])
        assert got[user]["seen"] == len(values) and got[user]["held"] == 50
        assert got[user]["mean"] == pytest.approx(sum(last) / 50) and got[user]["percentile"] == last[47]


def test_hash_chains_over_ten_batches_and_an_altered_row(spark, tmp_path):
    rows, path, work = events(200, 2), str(tmp_path / "in"), str(tmp_path / "work")
    files(spark, path, rows[:120], 6)
    schema = spark.read.parquet(path).schema
    make = lambda: stateful.chained(source(spark, path, schema), "user_id", "ts", "event_id", F.concat_ws("|", "event_id", "event_type"))
    stateful.run_batches(make(), work)
    files(spark, path, rows[120:], 4)
    chain = stateful.run_batches(make(), work)
    assert chain.count() == len(rows) and chain.select("batch").distinct().count() == 10
    assert stateful.broken_links(chain, "user_id").count() == 0
    altered = chain.withColumn("text", F.when((F.col("user_id") == 1) & (F.col("seq") == 5), "x").otherwise(F.col("text")))
    assert [(r["user_id"], r["seq"], r["wrong"]) for r in stateful.broken_links(altered, "user_id").collect()] == [(1, 5, "hash")]
    missing = chain.where("NOT (user_id = 2 AND seq = 7)")
    assert [(r["user_id"], r["seq"], r["wrong"]) for r in stateful.broken_links(missing, "user_id").collect()] == [(2, 8, "gap")]
    longest = max(chain.groupBy("user_id").agg(F.max("seq").alias("n")).collect(), key=lambda r: r["n"])
    assert longest["n"] == sum(r[1] == longest["user_id"] for r in rows)


def test_feedback_joined_and_learned_over_batches(spark, tmp_path):
    rows, path, work = events(300, 3), str(tmp_path / "in"), str(tmp_path / "work")
    rows = [(i, u, k, v, t) for i, u, k, v, t in rows]
    files(spark, path, rows[:200], 4)
    schema = spark.read.parquet(path).schema

    def make():
        views = source(spark, path, schema).where("event_type = 'view'").select(F.col("event_id").alias("id"), "user_id", F.concat(F.lit("c"), F.col("event_id") % 2).alias("class"), (F.col("value") / 50).alias("p"), F.col("ts").alias("at"))
        clicks = source(spark, path, schema).where("event_type = 'click'").select((F.col("event_id") - 1).alias("of"), F.col("event_id").alias("outcome_id"), (F.col("value") > 20).alias("right"), F.col("ts").alias("told"))
        return stateful.user_temperatures(stateful.feedback(views, clicks))

    stateful.run_batches(make(), work)
    files(spark, path, rows[200:], 2)
    out = stateful.run_batches(make(), work)
    got = {(r["user_id"], r["class"]): (r["temperature"], r["steps"]) for r in stateful.latest(out, "user_id", "class").collect()}
    want, by_id = {}, {r[0]: r for r in rows}
    for i, _, kind, value, _ in rows:
        if kind == "click" and i - 1 in by_id and by_id[i - 1][2] == "view":
            _, user, _, v, _ = by_id[i - 1]
            key = (user, f"c{(i - 1) % 2}")
            want[key] = stateful.temperature_step(*want.get(key, (1.0, 0)), v / 50, value > 20, 0.05, 0.01)
    assert set(got) == set(want)
    for k, (t, n) in want.items():
        assert got[k][1] == n and got[k][0] == pytest.approx(t)
    # a batch that is written again replaces itself
    before = out.count()
    number = out.agg(F.max("batch")).first()[0]
    again = out.where(F.col("batch") == number).drop("batch").toPandas()
    spark.createDataFrame(again, out.drop("batch").schema).write.mode("overwrite").parquet(f"{work}/out/batch={number}")
    assert spark.read.parquet(f"{work}/out").count() == before


def test_session_options_come_back(spark):
    with stateful.options(spark, {"spark.sql.shuffle.partitions": "3", "spark.some.option": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8" and spark.conf.get("spark.some.option", None) is None


def titled(n, seed):
    import datetime

    rnd, t = random.Random(seed), datetime.datetime(2024, 1, 1)
    words = [f"w{i}" for i in range(12)]
    return [(i, rnd.randrange(2), [rnd.choice(words) for _ in range(rnd.randrange(5))], [rnd.choice("ABCDE") for _ in range(rnd.randrange(3))], t + datetime.timedelta(hours=i)) for i in range(n)]


def greedy(rows, horizon, batch):
    """All clusters are looked at; those that end ``horizon`` hours before the latest event of the batches before are closed."""
    import math

    bundles, out, latest = {}, {}, None
    for n, (i, user, title, entities, at) in enumerate(rows):
        if n % batch == 0 and n:
            latest = rows[n - 1][4].timestamp() / 3600
        h, mine, best, where = at.timestamp() / 3600, bundles.setdefault(user, []), 0.3, None
        for k, (t, e, when) in enumerate(mine):
            if horizon is not None and latest is not None and mine[k][2] < latest - horizon:
                mine[k] = (set(), set(), -math.inf)
                continue
            s = 0.4 * stateful.jaccard(set(title), t) + 0.4 * stateful.jaccard(set(entities), e) + 0.2 * math.exp(-abs(h - when) / 48)
            if s > best:
                best, where = s, k
        if where is None:
            where = len(mine)
            mine.append((set(title), set(entities), h))
        else:
            t, e, when = mine[where]
            mine[where] = (t, e | set(entities), max(when, h))
        out[i] = where
    return out


@pytest.mark.parametrize("horizon", [None, 60.0])
def test_event_clusters_equal_the_greedy_ones(spark, tmp_path, horizon):
    rows, path, work = titled(160, 4), str(tmp_path / "in"), str(tmp_path / "work")
    schema = "event_id long, user_id long, title array<string>, entities array<string>, ts timestamp"

    def land(some):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path)

    def make():
        s = source(spark, path, spark.read.parquet(path).schema)
        s = s.withColumn("at", F.col("ts")).withWatermark("at", "0 seconds") if horizon is not None else s
        return stateful.event_clusters(s, "user_id", F.col("event_id"), F.unix_micros("ts") / 3.6e9, F.col("title"), F.col("entities"), horizon=horizon)

    for part in range(4):
        land(rows[part * 40 : part * 40 + 40])
        out = stateful.run_batches(make(), work, state=True)
    got = {r["id"]: r["cluster"] for r in out.collect()}
    want = greedy(rows, horizon, 40)
    assert got == want
    assert horizon is None or want != greedy(rows, None, 40)


def test_stream_clusters_equal_the_batch_ones(spark, sf):
    from heliograph.plans import registry

    rows = lambda q: sorted((r["conv_id"], r["turn"], r["cluster"]) for r in registry.QUERIES[q](spark, sf).collect())
    assert rows("st11_event_clusters") == rows("cl01_online_clusters")


def test_a_key_s_state_is_read_and_written_once_a_batch():
    import pandas as pd

    calls = []

    class State:
        held = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "update":
                    self.held = args[0]
                return {"exists": self.held is not None, "get": self.held, "iterator": iter(()), "containsKey": False}.get(name)

            return call

    class Handle:
        def getValueState(self, *_):
            return State()

        getMapState = getValueState

    made = stateful.EventClusters("user_id", 0.3, (0.4, 0.4, 0.2), 48, None)
    made.init(Handle())
    rows, got = [(i, float(i), [f"w{i % 5}", f"x{i % 3}"], [f"E{i % 7}"]) for i in range(60)], []
    for part in (rows[:30], rows[30:]):
        got += [x for f in made.handleInputRows((1,), iter([pd.DataFrame(part, columns=["id", "hour", "title", "entities"])]), None) for x in f["cluster"]]
    import datetime

    zero = datetime.datetime(2024, 1, 1)
    want = greedy([(i, 1, t, e, zero + datetime.timedelta(hours=i)) for i, _, t, e in rows], None, 100)
    assert got == [want[i] for i in range(60)]
    assert len(calls) == 4
