"""Rules of robots.txt files: agents, longest match with * and $, crawl delay."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "host string, agent string, path string, allow boolean, delay double"


def parse(content: str) -> Iterator[tuple[str, str | None, bool | None, float | None]]:
    """agent, path, allow and delay of each rule line of a file; a delay has no path. Lines of several agents in a row share what follows."""
    agents, open_ = [], False
    for line in (content or "").splitlines():
        field, colon, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            agents, open_ = [*(agents if open_ else []), value.lower()], True
            continue
        open_ = False
        for agent in agents:
            if field in ("allow", "disallow") and value:
                yield agent, value, field == "allow", None
            elif field in ("allow", "disallow"):
                yield agent, "/", True, None  # an empty rule forbids nothing
            elif field == "crawl-delay" and value.replace(".", "", 1).isdigit():
                yield agent, None, None, float(value)


def rules(files: DataFrame, host: str = "host", content: str = "content") -> DataFrame:
    """One row for each rule of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(h, *r) for h, text in zip(b["h"].to_pylist(), b["c"].to_pylist(), strict=True) for r in parse(text)]
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "agent", "path", "allow", "delay"])

    return files.select(F.lower(host).alias("h"), F.col(content).alias("c")).mapInArrow(run, RULES)


def pattern(path: Column) -> Column:
    """A rule's path as a regular expression from the path's beginning."""
    quoted = F.regexp_replace(F.regexp_replace(path, r"([^\w/*$%-])", r"\\$1"), r"\*+", ".*")
    anchored = F.regexp_replace(F.regexp_replace(quoted, r"\$(?=.)", r"\\\$"), r"\$$", r"\\z")
    return F.concat(F.lit("(?s)^"), anchored)


def for_agent(found: DataFrame, agent: str) -> DataFrame:
    """The rules that a host has for an agent: those of the longest agent name that is part of its name, else those of all agents."""
    token = agent.lower()
    named = found.where((F.col("agent") == "*") | F.contains(F.lit(token), F.col("agent")))
    rank = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    best = named.groupBy("host").agg(F.max(rank).alias("best"))
    return named.join(best, "host").where(rank == F.col("best")).drop("best")


def permissions(urls: DataFrame, found: DataFrame, agent: str = "*") -> DataFrame:
    """url, allowed and delay: the longest matching rule decides, of equals the one that allows; without any the url is allowed."""
    from ..functions.text import url_host

    own = for_agent(found, agent)
    u = urls.select("url").distinct().withColumns({"host": F.lower(url_host(F.col("url"))), "at": F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)})
    u = u.withColumn("at", F.when(F.col("at").startswith("/"), F.col("at")).otherwise(F.concat(F.lit("/"), "at")))
    r = own.where("path IS NOT NULL").select("host", "path", "allow", pattern(F.col("path")).alias("p"))
    hit = u.join(r, "host").where(F.regexp_like("at", "p"))
    best = hit.groupBy("url").agg(F.max(F.struct(F.length("path").alias("n"), "allow")).alias("b"))
    delays = own.where("delay IS NOT NULL").groupBy("host").agg(F.max("delay").alias("delay"))
    return u.join(best, "url", "left").join(delays, "host", "left").select("url", F.coalesce("b.allow", F.lit(True)).alias("allowed"), "delay")
