"""Sinks and maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import anti_new


def append_new(df: DataFrame, path: str, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Append rows whose key isn't in the Parquet table yet; with ``strict`` any known or repeated key fails the batch."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = spark.createDataFrame([], df.schema)
    if strict:
        again = df.groupBy(*keys).count().where("count > 1").select(*keys).unionByName(df.join(there.select(*keys), list(keys), "left_semi").select(*keys))
        if not again.isEmpty():
            raise ValueError(f"keys that are there already: {again.limit(5).collect()}")
    new = anti_new(df, there, keys)
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def audit_json(df: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One JSON object per audit event, in lines ordered within each tenant; lines, not one array, so that a tenant of any size fits."""
    return df.select(key, *order, F.to_json(F.struct(*columns)).alias("line")).repartition(key).sortWithinPartitions(key, *order)


def chat_lines(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """A chat-format JSON line for each conversation."""
    message = F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content"))
    messages = F.transform(F.array_sort(F.collect_list(message)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return df.groupBy(conversation).agg(F.to_json(F.struct(messages.alias("messages"))).alias("line"))


def digest_markdown(title: Column, items: Column) -> Column:
    """A digest section in Markdown from its title and an array of item texts."""
    return F.concat(F.lit("## "), title, F.lit("\n\n"), F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n"), F.lit("\n"))


def digest_html(title: Column, items: Column) -> Column:
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<h2>"), escape(title), F.lit("</h2><ul>"), F.array_join(F.transform(items, lambda i: F.concat(F.lit("<li>"), escape(i), F.lit("</li>"))), ""), F.lit("</ul>"))
