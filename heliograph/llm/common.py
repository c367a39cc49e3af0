"""Helpers shared by the corpus operators. Texts that are null are read as empty ones; empty tables give empty tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of one Arrow batch, whichever comes first; one text of any length still fits.
BATCH_ROWS, BATCH_BYTES = 20_000, "4m"

#: What a Python worker has loaded, and the module whose tasks it serves.
_loaded: dict[tuple[str, str], object] = {}
_serves: list[str] = [""]


def loaded(kind, path: str):
    """One ``kind(path)`` for each Python worker, as long as tasks of one module follow each other there."""
    key = (kind.__name__, path)
    if key not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]


def begun(module: str) -> None:
    """A task of ``module`` begins in this worker: what tasks of another one have loaded goes."""
    if _serves[0] != module:
        _serves[0] = module
        if _loaded:
            _loaded.clear()
            gc.collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` of the input, null texts as empty ones; other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches. Workers outlive their tasks; what Arrow holds without need is given back at a task's end."""
    module = fn.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(module)
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()

    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(task, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Catalyst may copy an aliased expression into each place, even into a lambda, that mentions it.
    A lambda variable is computed once.
    """
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.conf.get("spark.master").partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: the rows are computed once and kept in the shared folder, where a lost executor doesn't matter."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them again: columnar, and pruned by later readers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def groups_by_size(values: Iterable[str], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``limit`` characters each, one text at least."""
    start, held = 0, 0
    n = 0
    for n, v in enumerate(values, 1):
        held += len(v)
        if held >= limit:
            yield start, n
            start, held = n, 0
    if start < n:
        yield start, n
