"""Sources and sinks that the driver's tables can stand in for."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import relational
from ..operators.state import shared_dir
from ..sources import connectors, sinks
from .registry import SIGNALS, query, signals, table


@query("src14_changelog_sections", r"""SELECT item_id, count(*) AS versions FROM (SELECT item_id, unnest(string_split(text, '. ')) AS part FROM benchmark) WHERE regexp_matches(part, '^[A-Z]') GROUP BY item_id""")
def changelog_sections(spark, d):
    parts = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", r"\. ")).alias("part"))
    return parts.where(F.col("part").rlike("^[A-Z]")).groupBy("item_id").agg(F.count("*").alias("versions"))


@query("src15_docs_monitor", r"""SELECT url, hash FROM (SELECT url, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<nav\b.*?</nav>', ' ', 'gis'), '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS hash FROM pages) WHERE NOT contains(url, '?')""")
def docs_monitor(spark, d):
    """Pages with parameters were seen before, unchanged."""
    p = table(spark, d, "pages").where("url IS NOT NULL")
    seen = p.where(F.contains("url", F.lit("?"))).select("url", connectors.page_hash(F.col("html")).alias("hash"))
    return connectors.changed_pages(p, seen)


@query("src19_entity_kb", "SELECT lower(n_name) AS surface, n_nationkey AS canonical_id, n_name AS name FROM nation")
def entity_kb(spark, d):
    return table(spark, d, "nation").select(F.lower("n_name").alias("surface"), F.col("n_nationkey").alias("canonical_id"), F.col("n_name").alias("name"))


@query("src22_robots", r"SELECT DISTINCT url, NOT (regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) = 'ththre.example.com' AND starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), '/fr')) AS allowed FROM pages")
def robots(spark, d):
    allowed = spark.createDataFrame([("ththre.example.com", "/fr", False), ("ththre.example.com", "/", True)], "host string, path string, allow boolean")
    return connectors.robots_allowed(table(spark, d, "pages").select("url"), allowed)


@query("src23_config_scan", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_nationkey = 3")
def config_scan(spark, d):
    return table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))


@query("snk01_append_new", "SELECT DISTINCT source, lang FROM documents")
def append_new(spark, d):
    """Two appends of the same keys leave one row for each."""
    path = f"{shared_dir(spark).rstrip('/')}/append-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").select("source", "lang")
    sinks.append_new(rows.where("lang = 'en'"), path, ["source", "lang"])
    return sinks.append_new(rows, path, ["source", "lang"])


@query("snk03_insert_or_ignore", "SELECT DISTINCT user_id, event_type FROM events")
def insert_or_ignore(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/ignore-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("user_id", "event_type")
    sinks.append_new(rows, path, ["user_id", "event_type"])
    return sinks.append_new(rows, path, ["user_id", "event_type"])


@query("snk08_audit_export", """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS line FROM events""")
def audit_export(spark, d):
    return sinks.audit_json(table(spark, d, "events"), "event_type", ["event_id", "event_type"], ["event_id"]).select("event_id", "line")


@query("snk09_chat_export")
def chat_export(spark, d):
    return sinks.chat_lines(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("snk10_digest_markdown", "SELECT lang, '## ' || lang || chr(10) || chr(10) || string_agg('- ' || source, chr(10) ORDER BY source) || chr(10) AS section FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def digest_markdown(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("items"))
    return g.select("lang", sinks.digest_markdown(F.col("lang"), F.col("items")).alias("section"))


def json_lines(spark, d, extra: str = ""):
    """A dataset as JSON lines in the shared folder, a blank line behind each; ``extra`` is one more line, too."""
    path = f"{shared_dir(spark).rstrip('/')}/jsonl-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").select(F.concat(F.to_json(F.struct("doc_id", "lang", "source")), F.lit("\n" + extra)).alias("value"))
    rows.write.text(path)
    return path


DATASET = "doc_id long, lang string, source string"


@query("src18_jsonl_load", "SELECT doc_id, lang, source FROM documents")
def jsonl_load(spark, d):
    """A JSON-lines dataset: blank lines are skipped, a bad line is an error."""
    return connectors.json_lines(spark, json_lines(spark, d), DATASET)


@query("r20_audit_log", "SELECT doc_id, lang, source FROM documents")
def audit_log(spark, d):
    """An audit log of JSON lines: corrupt lines are skipped."""
    return connectors.json_lines(spark, json_lines(spark, d, '{"doc_id": 1, "lang": '), DATASET, skip_corrupt=True)


@query("snk02_insert_signals", f"SELECT id, user_id, status, signal_type, action_score FROM ({SIGNALS}) WHERE status <> 'ACTED'")
def insert_signals(spark, d):
    """Open signals appended to a table in two batches, one a status; a later batch adds rows and changes none."""
    path = f"{shared_dir(spark).rstrip('/')}/signals-{uuid.uuid4().hex}"
    for status in ("NEW", "IN_PROGRESS"):
        signals(spark, d).where(F.col("status") == status).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("id", "user_id", "status", "signal_type", "action_score")


@query("snk11_state_snapshot", "SELECT user_id, count(*) AS n, max(event_id) AS latest FROM events GROUP BY user_id")
def state_snapshot(spark, d):
    """Each user's state written as JSON and loaded again by its schema."""
    path = f"{shared_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    state = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("latest"))
    state.write.json(path)
    return spark.read.schema(state.schema).json(path)


@query("r29_page_of_range", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def page_of_range(spark, d):
    """The third page of the events in a range of dates, newest first; a bad page or range is an error."""
    limit, offset = rules.page_bounds(3, 50)
    first, last = rules.date_range("2024-01-05", "2024-01-12")
    found = table(spark, d, "events").where(F.col("ts").between(F.lit(first), F.lit(last)))
    return relational.page(found.select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], limit, offset)


#: One robots.txt for every host, with groups, wildcards, an end and a delay.
ROBOTS = "User-agent: *\nDisallow: /\nAllow: /fr\nDisallow: /fr*e$\nCrawl-delay: 2.5\n\nUser-agent: other\nUser-agent: collector # and its kin\nDisallow: /*a\nAllow: /*an\nDisallow:"


@query("src22_robots_rules", r"""WITH u AS (SELECT DISTINCT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS p FROM pages), v AS (SELECT url, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS p FROM u)
SELECT url, CASE WHEN regexp_matches(p, '^/fr.*e$') THEN FALSE ELSE starts_with(p, '/fr') END AS allowed, regexp_matches(p, '^/.*an') OR NOT regexp_matches(p, '^/.*a') AS collector, CAST(2.5 AS DOUBLE) AS delay FROM v""")
def robots_rules(spark, d):
    """What all agents and what one with a group of its own may fetch, by the longest rule."""
    from ..functions.text import url_host
    from ..sources import robots as robots_files

    pages = table(spark, d, "pages").select("url")
    found = robots_files.rules(pages.select(url_host(F.col("url")).alias("host")).distinct().withColumn("content", F.lit(ROBOTS)))
    mine = robots_files.permissions(pages, found, "Collector/2.0").select("url", F.col("allowed").alias("collector"))
    return robots_files.permissions(pages, found).join(mine, "url").select("url", "allowed", "collector", "delay")


@query("src20_platform_priors", "SELECT doc_id, t AS signal_type, CAST(p AS DOUBLE) AS prior FROM documents JOIN (VALUES ('src0', 'support_request', 0.3), ('src0', 'feature_request', 0.2), ('src0', 'competitor_mention', 0.15), ('src0', 'alternative_seeking', 0.15), ('src1', 'competitor_mention', 0.25), ('src1', 'complaint', 0.2), ('src1', 'churn_risk', 0.15)) AS v(s, t, p) ON source = s")
def platform_priors(spark, d):
    """Documents of two sources, which stand for platforms, with the built-in priors, since no file is there."""
    from ..sources import exemplars

    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("source") == "src0", "Reddit").when(F.col("source") == "src1", "Twitter").alias("p"))
    return exemplars.candidates(docs.where("p IS NOT NULL"), exemplars.load_priors(spark, None), F.col("p")).select("doc_id", "signal_type", "prior")


@query("src20_exemplar_bank", "SELECT CAST(label AS VARCHAR) AS signal_type, count(*) AS exemplars, round(avg(len(embedding)), 6) AS dims FROM embeddings GROUP BY label")
def exemplar_bank(spark, d):
    """All embeddings saved as a bank of exemplars and loaded again."""
    from ..sources import exemplars

    path = f"{shared_dir(spark).rstrip('/')}/bank-{uuid.uuid4().hex}"
    e = table(spark, d, "embeddings")
    exemplars.save_bank(e.select(F.col("label").cast("string").alias("signal_type"), F.concat(F.lit("vector "), "vec_id").alias("text"), F.col("embedding").cast("array<double>").alias("embedding"), F.array(F.lit("x")).alias("entities"), F.lit("p").alias("platform")), path)
    bank = exemplars.load_bank(spark, path)
    return bank.groupBy("signal_type").agg(F.count("*").alias("exemplars"), F.round(F.avg(F.size("embedding")), 6).alias("dims"))
