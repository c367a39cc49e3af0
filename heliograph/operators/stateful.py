"""Keyed state over streams: ring buffers of observations, hash chains, and temperatures learned from joined feedback.

State is in the stream's checkpoint, so that a query that was stopped goes on where it was. Sinks write each batch into a folder of its
number; a batch that is run again replaces itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Fixed value: what the first entry of a chain follows.
GENESIS = "GENESIS"


@contextmanager
def options(spark: SparkSession, wanted: dict[str, str]):
    """Session options for the time of a block; those of before come back."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_batches(stream: DataFrame, path: str, mode: str = "append", state: bool = False) -> DataFrame:
    """Run what is there now and stop: each batch becomes ``path/out/batch=<number>``. Called again, it goes on; the rows of all batches so far come back."""
    spark = stream.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    with options(spark, STORE if state else {}):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{path}/out")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of each key's last batch."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


class Ring(StatefulProcessor):
    """The last ``size`` observations of a key, in numbered slots of which each observation replaces one; slots that aren't written for ``expiry`` go."""

    def __init__(self, key: str, size: int, percent: float, expiry_ms: int | None):
        self.key, self.size, self.percent, self.expiry_ms = key, size, percent, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "value double", self.expiry_ms)
        self.next = handle.getValueState("next", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["at", "id"])
        n = self.next.get()[0] if self.next.exists() else 0
        # of more than a ring's worth only the last can stay
        for i, value in list(enumerate(seen["value"], n))[-self.size :]:
            self.slots.updateValue((int(i % self.size),), (float(value),))
        n += len(seen)
        self.next.update((int(n),))
        held = sorted(v[0] for v in self.slots.values())
        rank = max(0, math.ceil(self.percent / 100 * len(held)) - 1)
        yield pd.DataFrame({self.key: [key[0]], "seen": [n], "held": [len(held)], "mean": [math.fsum(held) / len(held)], "percentile": [held[rank]]})

    def close(self) -> None:
        pass


def ring_buffer(stream: DataFrame, key: str, at: Column, id_: Column, value: Column, size: int = 10_000, percent: float = 95, expiry_ms: int | None = None) -> DataFrame:
    """Of each key that a batch has rows of: number seen, number held (the last ``size`` in order of arrival, within a batch by ``at`` and ``id_``), their mean and nearest-rank percentile."""
    kind = dict(stream.dtypes)[key]
    read = stream.select(key, at.alias("at"), id_.alias("id"), value.cast("double").alias("value")).where(F.col("value").isNotNull() & F.col(key).isNotNull())
    return read.groupBy(key).transformWithStateInPandas(Ring(key, size, percent, expiry_ms), f"{key} {kind}, seen long, held long, mean double, percentile double", "Update", "ProcessingTime" if expiry_ms else "None")


def chained(stream: DataFrame, tenant: str, at: str, id_: str, text: Column) -> DataFrame:
    """tenant, seq (from 1), id, text, prev and hash: each entry's hash is sha256 of the one before and the entry's canonical text; the tip of each tenant is state."""
    kinds = dict(stream.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tip, n = state.get if state.exists else (GENESIS, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out = []
        for id_, text in zip(rows["id"], rows["text"], strict=True):
            prev, n = tip, n + 1
            tip = hashlib.sha256((prev + text).encode()).hexdigest()
            out.append((key[0], n, id_, text, prev, tip))
        state.update((tip, n))
        yield pd.DataFrame(out, columns=[tenant, "seq", "id", "text", "prev", "hash"])

    read = stream.select(tenant, F.col(at).alias("at"), F.col(id_).alias("id"), text.alias("text"))
    return read.groupBy(tenant).applyInPandasWithState(step, f"{tenant} {kinds[tenant]}, seq long, id {kinds[id_]}, text string, prev string, hash string", "tip string, n long", "append", GroupStateTimeout.NoTimeout)


def broken_links(chain: DataFrame, tenant: str) -> DataFrame:
    """tenant, seq and what is wrong (hash, link, gap) of entries that don't verify. Every entry is checked by itself and against the one before it, by a join on the number, so that one tenant's chain is verified by many tasks."""
    own = chain.select(tenant, "seq", "prev", "hash", (F.sha2(F.concat("prev", "text"), 256) == F.col("hash")).alias("right"))
    before = chain.select(F.col(tenant).alias("_tenant"), (F.col("seq") + 1).alias("_next"), F.col("hash").alias("_before"))
    both = own.join(before, (F.col(tenant) == F.col("_tenant")) & (F.col("seq") == F.col("_next")), "left")
    start = (F.col("seq") == 1) & (F.col("prev") == GENESIS)
    wrong = F.when(~F.col("right"), "hash").when(F.col("_before").isNull() & ~start, "gap").when(F.col("_before") != F.col("prev"), "link")
    return both.select(tenant, "seq", wrong.alias("wrong")).where("wrong IS NOT NULL")


def feedback(predictions: DataFrame, outcomes: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Predictions (id, user_id, class, p, at) with the outcomes (of, outcome_id, right, told) that follow them ``within`` some time; both sides' state goes with the watermarks."""
    p = predictions.withWatermark("at", late)
    o = outcomes.withWatermark("told", late)
    return p.join(o, F.expr(f"id = of AND told >= at AND told <= at + INTERVAL {within}")).select("user_id", "class", "p", "right", "told", "outcome_id")


def temperature_step(t: float, n: int, p: float, right: bool, rate: float, decay: float) -> tuple[float, int]:
    """One gradient step on a temperature, with a rate that falls with the steps so far."""
    p = min(max(p, 1e-6), 1 - 1e-6)
    z = math.log(p / (1 - p))
    gradient = (1 / (1 + math.exp(-z / t)) - right) * -z / (t * t)
    return min(10.0, max(0.1, t - rate / (1 + decay * n) * gradient)), n + 1


def user_temperatures(joined: DataFrame, rate: float = 0.05, decay: float = 0.01) -> DataFrame:
    """Temperature and number of steps of each (user, class) after a batch of joined feedback. A user's classes are one value of state, since a group costs more than its few rows."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}  # class -> [temperature, steps]
        rows = list(frames)
        rows = pd.concat(rows) if len(rows) > 1 else rows[0]
        order = np.lexsort((rows["outcome_id"].to_numpy(), rows["told"].to_numpy()))
        seen = {}
        for c, p, right in zip(*(rows[name].to_numpy()[order].tolist() for name in ("class", "p", "right")), strict=True):
            t, n = known.get(c, (1.0, 0))
            known[c] = seen[c] = temperature_step(t, int(n), float(p), bool(right), rate, decay)
        state.update((list(known), [[float(t), float(n)] for t, n in known.values()]))
        yield pd.DataFrame({"user_id": [key[0]] * len(seen), "class": list(seen), "temperature": [t for t, _ in seen.values()], "steps": [n for _, n in seen.values()]})

    kind = dict(joined.dtypes)["user_id"]
    return joined.groupBy("user_id").applyInPandasWithState(step, f"user_id {kind}, class string, temperature double, steps long", "classes array<string>, learned array<array<double>>", "append", GroupStateTimeout.NoTimeout)


def calibrated(confidence: Column, temperature: Column, steps: Column, full: int = 50, most: float = 0.7) -> Column:
    """A confidence by the user's temperature, blended with 1 by how many outcomes it was learned from; without any it stays."""
    share = F.least(F.lit(most), most * F.coalesce(steps, F.lit(0)) / full)
    t = share * F.coalesce(temperature, F.lit(1.0)) + (1 - share)
    p = F.greatest(F.least(confidence, F.lit(1 - 1e-6)), F.lit(1e-6))
    return 1 / (1 + F.exp(-F.log(p / (1 - p)) / t))


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


class EventClusters(StatefulProcessor):
    """Open clusters of a key: title of the first event, all entities, latest hour.

    A key's open clusters are one value, read and written once a batch; in between an index by token in memory leads an
    event to the clusters that share a token with it only: time alone can't reach the threshold. Clusters whose latest event is
    ``horizon`` hours behind the watermark are closed and their state goes.
    """

    def __init__(self, key: str, least: float, weights: tuple[float, float, float], decay: float, horizon: float | None):
        self.key, self.least, self.weights, self.decay, self.horizon = key, least, weights, decay, horizon
        if weights[2] > least:
            raise ValueError("time alone must not reach the threshold")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "next int, clusters array<struct<k:int,title:array<string>,entities:array<string>,hour:double>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, held = self.state.get() or (0, [])
        known, out = {k: (set(t), set(e), hour) for k, t, e, hour in held}, []
        if self.horizon is not None:
            least = timerValues.getCurrentWatermarkInMs() / 3_600_000 - self.horizon
            known = {k: c for k, c in known.items() if c[2] >= least}
        holders: dict[str, set[int]] = {}
        marks = lambda title, entities: {*(f"t:{w}" for w in title), *(f"e:{w}" for w in entities)}
        for k, (t, e, _) in known.items():
            for m in marks(t, e):
                holders.setdefault(m, set()).add(k)
        for r in pd.concat(list(rows)).sort_values(["hour", "id"]).itertuples():
            title, entities = set(r.title), set(r.entities)
            best, at = self.least, None
            for k in sorted({k for m in marks(title, entities) for k in holders.get(m, ())}):
                t, e, hour = known[k]
                near = self.weights[0] * jaccard(title, t) + self.weights[1] * jaccard(entities, e) + self.weights[2] * math.exp(-abs(r.hour - hour) / self.decay)
                if near > best:
                    best, at = near, k
            if at is None:
                at, n, added = n, n + 1, marks(title, entities)
                known[at] = (title, entities, float(r.hour))
            else:
                t, e, hour = known[at]
                added = marks((), entities - e)
                known[at] = (t, e | entities, max(hour, float(r.hour)))
            for m in added:
                holders.setdefault(m, set()).add(at)
            out.append((key[0], r.id, at))
        self.state.update((n, [(k, sorted(t), sorted(e), hour) for k, (t, e, hour) in known.items()]))
        yield pd.DataFrame(out, columns=[self.key, "id", "cluster"])

    def close(self) -> None:
        pass


def event_clusters(stream: DataFrame, key: str, id_: Column, hour: Column, title: Column, entities: Column, least: float = 0.3, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), decay: float = 48, horizon: float | None = None) -> DataFrame:
    """key, id and the number of the event cluster within its key that each row joins as it arrives.

    ``hour`` orders rows and ages clusters; with a ``horizon`` (hours) the stream needs a watermark. Titles and entities are arrays of strings, null as empty.
    """
    kinds = dict(stream.select(key, id_.alias("_id")).dtypes)
    none = F.array().cast("array<string>")
    read = stream.select(key, id_.alias("id"), hour.cast("double").alias("hour"), F.coalesce(title, none).alias("title"), F.coalesce(entities, none).alias("entities"), *([F.col(c) for c in ("at",) if horizon is not None]))
    made = EventClusters(key, least, weights, decay, horizon)
    return read.groupBy(key).transformWithStateInPandas(made, f"{key} {kinds[key]}, id {kinds['_id']}, cluster long", "Append", "EventTime" if horizon is not None else "None")
