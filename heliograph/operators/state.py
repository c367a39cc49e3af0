"""Cutting lineage between the rounds of iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir; a local one only in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master").partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), "checkpoints")
    return where


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them again. Unlike a checkpoint this also drops what the planner has inferred about the rows, which grows with each round of a long loop."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
