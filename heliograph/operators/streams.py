"""Structured Streaming operators: event time, watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; only new files are read, offsets are in the checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, sink, mode: str = "append") -> StreamingQuery:
    """Run what is there now through foreachBatch and stop."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def trend_counts(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Counts of each key over windows of seven days that move by one day; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "7 days", "1 day"), key).agg(F.count("*").alias("n"))


def dedup_within(stream: DataFrame, keys: list[str], at: str, span: str = "24 hours") -> DataFrame:
    """First of equal keys within the span; state goes when the watermark passes."""
    return stream.withWatermark(at, span).dropDuplicatesWithinWatermark(keys)


def session_counts(stream: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def online_temperature(stream: DataFrame, key: str, p: str, y: str, rate: float = 0.05) -> DataFrame:
    """Temperature of each key after online gradient steps, kept as keyed state over the micro-batches."""
    import math

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, n = state.get if state.exists else (1.5, 0)
        for frame in frames:
            for prob, label in zip(frame[p], frame[y], strict=True):
                prob = min(max(float(prob), 1e-6), 1 - 1e-6)
                z = math.log(prob / (1 - prob))
                q = 1 / (1 + math.exp(-z / t))
                t = min(100.0, max(0.1, t + rate / (1 + 0.01 * n) * (q - label) * z / (t * t)))
                n += 1
        state.update((t, n))
        yield pd.DataFrame({key: [k[0]], "temperature": [t], "updates": [n]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, temperature double, updates long", "t double, n long", "update", GroupStateTimeout.NoTimeout)


def circuit_state(stream: DataFrame, key: str, failed: str, threshold: int = 3) -> DataFrame:
    """Failures in a row of each key and whether they open its circuit."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        for frame in frames:
            for bad in frame.sort_values("at")[failed]:
                run = run + 1 if bad else 0
        state.update((run,))
        yield pd.DataFrame({key: [k[0]], "failures": [run], "open": [run >= threshold]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, failures long, open boolean", "run long", "update", GroupStateTimeout.NoTimeout)
