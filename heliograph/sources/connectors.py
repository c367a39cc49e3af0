"""Connectors read payloads that a fetcher has landed as files; nothing here touches a network.

All give the same columns, so that they can be united: ``source_platform, source_id, title, body, url, author,
media_type, published_at``. ``since`` is strict, as is the cut of ``most`` newest items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

COLUMNS = ("source_platform", "source_id", "title", "body", "url", "author", "media_type", "published_at")

#: Where each JSON platform keeps the item list ("" for one item a line) and each column.
JSON_FIELDS = {
    "youtube": ("items", "id.videoId", "snippet.title", "snippet.description", None, "snippet.channelTitle", "VIDEO", "snippet.publishedAt"),
    "reddit": ("data.children", "data.id", "data.title", "data.selftext", "data.url", "data.author", "TEXT", "data.created_utc"),
    "tiktok": ("data.videos", "id", "video_description", "video_description", "share_url", "username", "VIDEO", "create_time"),
    "facebook": ("data", "id", "story", "message", "permalink_url", "from.name", "TEXT", "created_time"),
    "instagram": ("data", "id", "caption", "caption", "permalink", "username", "IMAGE", "timestamp"),
    "wechat": ("item", "media_id", "content.news_item[0].title", "content.news_item[0].content", "content.news_item[0].url", "content.news_item[0].author", "TEXT", "update_time"),
    "nytimes": ("results", "uri", "title", "abstract", "url", "byline", "TEXT", "published_date"),
    "github_releases": ("", "id", "name", "body", "html_url", "author.login", "TEXT", "published_at"),
    "github_events": ("", "id", "type", "payload.action", "repo.url", "actor.login", "TEXT", "created_at"),
    "github_discussions": ("data.repository.discussions.nodes", "id", "title", "body", "url", "author.login", "TEXT", "createdAt"),
    "openreview": ("notes", "id", "content.title", "content.abstract", None, "content.authors[0]", "TEXT", "cdate"),
    "semantic_scholar": ("data", "paperId", "title", "abstract", "url", "authors[0].name", "TEXT", "publicationDate"),
}

#: Feeds in RSS or Atom form.
FEEDS = ("rss", "podcast_rss", "transcript_feed", "wsj", "abc_news", "google_news", "apple_news", "arxiv")


def limited(df: DataFrame, since: datetime | None, most: int | None) -> DataFrame:
    df = df.where(F.col("published_at") > F.lit(since)) if since else df
    return df.orderBy(F.desc("published_at"), "source_id").limit(most) if most else df


def timestamp(c: Column) -> Column:
    """ISO, RFC 822 or epoch (seconds or milliseconds) times; null where none fits."""
    n = c.try_cast("double")
    epoch = F.timestamp_micros((F.when(n > 1e11, n * 1000).otherwise(n * 1_000_000)).cast("long"))
    rfc = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "^[A-Za-z]{3}, ", ""), " (?:GMT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.when(n.isNotNull(), epoch).when(c.rlike(r"^\d{4}-"), c.try_cast("timestamp")).otherwise(rfc)


def json_items(spark: SparkSession, path: str, platform: str, since: datetime | None = None, most: int | None = None) -> DataFrame:
    """Items of landed JSON responses; each file is one response, or for line platforms each line an item."""
    root, *fields, media, at = JSON_FIELDS[platform]
    if root:
        raw = spark.read.text(path, wholetext=True)
        items = raw.select(F.explode(F.from_json(F.get_json_object("value", f"$.{root}"), "array<string>")).alias("j"))
    else:
        items = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("j"))
    get = lambda p: F.get_json_object("j", f"$.{p}") if p else F.lit(None).cast("string")
    out = items.select(F.lit(platform).alias("source_platform"), *(get(p).alias(c) for p, c in zip(fields, COLUMNS[1:6], strict=True)), F.lit(media).alias("media_type"), timestamp(get(at)).alias("published_at"))
    return limited(out.dropDuplicates(["source_platform", "source_id"]), since, most)


def feed_items(spark: SparkSession, path: str, platform: str = "rss", since: datetime | None = None, most: int | None = None) -> DataFrame:
    """Items of RSS and entries of Atom files; content before summary before description, the first enclosure's type as media type."""
    raw = spark.read.text(path, wholetext=True)
    each = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<(item|entry)\b.*?</\1>"), F.lit(0))).alias("x"))

    def tag(*names: str) -> Column:
        one = lambda n: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?s)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")), F.lit(""))
        return F.coalesce(*map(one, names))

    link = F.coalesce(tag("link"), F.nullif(F.regexp_extract("x", r"""<link[^>]*href=["']([^"']+)""", 1), F.lit("")))
    kind = F.regexp_extract("x", r"""<enclosure[^>]*type=["']([a-z]+)/""", 1)
    media = F.when(kind == "audio", "AUDIO").when(kind == "video", "VIDEO").when(kind == "image", "IMAGE").otherwise("TEXT")
    out = each.select(
        F.lit(platform).alias("source_platform"), F.coalesce(tag("guid", "id"), link).alias("source_id"), tag("title").alias("title"), tag("content:encoded", "content", "summary", "description").alias("body"),
        link.alias("url"), tag("dc:creator", "author", "name").alias("author"), media.alias("media_type"), timestamp(tag("pubDate", "published", "updated")).alias("published_at"),
    )
    return limited(out.dropDuplicates(["source_platform", "source_id"]), since, most)


def changelog_versions(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per version heading of a changelog: key, place, version, released, body."""
    parts = F.split(F.col(text), r"(?m)^(?=#{1,3} *\[?v?\d+\.\d+)")
    each = df.select(key, F.posexplode(parts).alias("place", "part")).where(F.col("part").rlike(r"^#{1,3} *\[?v?\d+\.\d+"))
    return each.select(key, "place", F.regexp_extract("part", r"^#{1,3} *\[?v?(\d+(?:\.\d+)+)", 1).alias("version"), F.to_date(F.nullif(F.regexp_extract("part", r"^[^\n]*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))).alias("released"), F.trim(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("body"))


def page_hash(html: Column) -> Column:
    """SHA-256 of a page's text without navigation and markup."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(nav|script|style)\b.*?</\1>", " "), "<[^>]+>", " ")
    return F.sha2(F.trim(F.regexp_replace(plain, r"\s+", " ")), 256)


def changed_pages(now: DataFrame, before: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Pages that are new or whose text differs from the last hashes (key, hash), with their new hash; of a key with several hashes any may match."""
    hashed = now.select(key, page_hash(F.col(html)).alias("hash"))
    old = before.select(F.col(key).alias("_key"), F.col("hash").alias("_old"))
    return hashed.join(old, (F.col(key) == F.col("_key")) & F.col("hash").eqNullSafe(F.col("_old")), "left_anti")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and allowed: the longest matching rule (host, path, allow) of its host decides, none allows."""
    from ..functions.text import url_host

    u = urls.select("url", url_host(F.col("url")).alias("host"), F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1).alias("path"))
    r = rules.select("host", F.col("path").alias("prefix"), "allow")
    hit = u.join(r, "host", "left").where(F.col("prefix").isNull() | F.col("path").startswith(F.col("prefix")))
    best = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return u.select("url").distinct().join(best, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))


class Registry:
    """Platform name -> reader(spark, path, since, most); more can be registered."""

    def __init__(self):
        self.readers: dict[str, Callable] = {p: (lambda s, path, since=None, most=None, p=p: json_items(s, path, p, since, most)) for p in JSON_FIELDS}
        self.readers |= {p: (lambda s, path, since=None, most=None, p=p: feed_items(s, path, p, since, most)) for p in FEEDS}

    def register(self, platform: str, reader: Callable) -> None:
        self.readers[platform] = reader

    def read(self, spark: SparkSession, platform: str, path: str, since: datetime | None = None, most: int | None = None) -> DataFrame:
        if platform not in self.readers:
            raise KeyError(f"no connector for {platform}")
        return self.readers[platform](spark, path, since, most)


class ItemsSource(DataSource):
    """``spark.read.format("heliograph_items")``: items that a callable gives, for connectors written in Python.

    Options: module and function, which is called with the other options and yields rows of ``COLUMNS``.
    """

    @classmethod
    def name(cls) -> str:
        return "heliograph_items"

    def schema(self) -> str:
        return ", ".join(f"{c} {'timestamp' if c == 'published_at' else 'string'}" for c in COLUMNS)

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)

        class Reader(DataSourceReader):
            def read(self, partition) -> Iterator[tuple]:
                import importlib

                yield from getattr(importlib.import_module(options["module"]), options["function"])(options)

        return Reader()


def json_lines(spark: SparkSession, path: str, schema: str, skip_corrupt: bool = False) -> DataFrame:
    """Rows of JSON lines. Blank lines are skipped; a line that can't be read is an error, or skipped as well."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_corrupt else "FAILFAST").json(path)
