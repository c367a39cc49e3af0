"""Sketches: Bloom filter, Count-Min, distinct counts, reservoirs. All merge, so that each partition gives a part."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n items at a false-positive rate p."""
    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return bits, max(1, math.ceil(bits / n * math.log(2)))


def positions(item: Column, bits: int, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.xxhash64(item, i), F.lit(bits)))


def bloom(df: DataFrame, item: Column, bits: int, k: int) -> DataFrame:
    """The filter as words of 63 bits: word and mask, one row for each word with any bit."""
    pos = df.select(F.explode(positions(item, bits, k)).alias("p"))
    return pos.groupBy(F.floor(F.col("p") / 63).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 63 as int))")).alias("mask"))


def might_contain(df: DataFrame, item: Column, key: str, filt: DataFrame, bits: int, k: int) -> DataFrame:
    """key and maybe: whether the filter may hold the row's item. Never false for one that it holds."""
    each = df.select(key, F.explode(positions(item, bits, k)).alias("p")).withColumn("word", F.floor(F.col("p") / 63))
    hit = F.coalesce(F.expr("mask & shiftleft(1L, cast(p % 63 as int))") != 0, F.lit(False))
    return each.join(filt, "word", "left").groupBy(key).agg(F.min(hit).alias("maybe"))


def cells(item: Column | str, width: int, depth: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.struct(i.alias("row"), F.pmod(F.xxhash64(item, i), F.lit(width)).alias("bucket")))


def count_min(df: DataFrame, item: Column, width: int = 1000, depth: int = 5) -> DataFrame:
    """row, bucket, total of a Count-Min sketch."""
    counted = df.select(item.alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return counted.select("n", F.explode(cells("item", width, depth)).alias("c")).groupBy("c.row", "c.bucket").agg(F.sum("n").alias("total"))


def estimates(items: DataFrame, item: str, sketch: DataFrame, width: int = 1000, depth: int = 5) -> DataFrame:
    """item and estimate: the least of its cells, never below the true count."""
    each = items.select(item, F.explode(cells(item, width, depth)).alias("c")).select(item, "c.row", "c.bucket")
    return each.join(sketch, ["row", "bucket"], "left").groupBy(item).agg(F.min(F.coalesce("total", F.lit(0))).alias("estimate"))


def reservoir(df: DataFrame, k: int, seed: int, id_col: str, weight: Column | None = None) -> DataFrame:
    """k rows at random without replacement, by weight if given (key u^(1/w)); the draw follows from seed and id."""
    u = (F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 52)) + 1) / float(1 << 52)
    key = u if weight is None else F.pow(u, 1 / weight)
    return df.orderBy(F.desc(key), id_col).limit(k)
