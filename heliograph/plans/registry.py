"""Named queries over the driver's tables, with the SQL that gives the same rows.

Each query applies one operator to a whole table. The tables stand in for the operators' own inputs: orders for the
signal queue, events for timed observations and feedback, documents for posts, embeddings for exemplars, pages for
monitored pages, conversations for threads.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "ag03_trending_topics"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its DuckDB SQL where there is one. Times are read as UTC."""

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's, times as TIMESTAMP."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    times = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(times) if times else df


#: The signal queue as orders give it, in both dialects.
SIGNALS = """SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'NEW' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'ACTED' END AS status,
 o_orderpriority AS signal_type, least(o_totalprice / 500000, 1.0) AS action_score, o_orderdate AS created_at FROM orders"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "O", "NEW").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("ACTED").alias("status"),
        F.col("o_orderpriority").alias("signal_type"),
        F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("action_score"),
        F.col("o_orderdate").alias("created_at"),
    )


for _part in ("filters", "joins", "aggregates", "windows", "sorts", "sets", "graphs", "scalars", "rules", "evaluation", "streams", "sources"):
    importlib.import_module(f"heliograph.plans.{_part}")
