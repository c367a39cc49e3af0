"""Graphs and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, sketches
from .registry import query, table

#: Part -> part edges: two lines of one order that follow each other.
EDGES = "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey"


def edges(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    after = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return l.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").where("src <> dst").distinct()


@query("g01_bfs_distances", f"""WITH RECURSIVE e AS ({EDGES}), r(node, dist) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, r.dist + 1 FROM r JOIN e ON e.src = r.node WHERE r.dist < 3) SELECT node, CAST(min(dist) AS BIGINT) AS dist FROM r GROUP BY node""")
def bfs_distances(spark, d):
    return graphs.bfs_distances(edges(spark, d), spark.range(1).toDF("node"), 3)


CRAWL_SQL = f"""WITH RECURSIVE e AS ({EDGES}), k AS (SELECT src, dst FROM (SELECT src, dst, p_size / 50 AS p FROM e JOIN part ON p_partkey = dst) WHERE p >= 0.5 QUALIFY row_number() OVER (PARTITION BY src ORDER BY p DESC, dst) <= 5),
r(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT k.dst, r.depth + 1 FROM r JOIN k ON k.src = r.node WHERE r.depth < 3) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node"""


@query("g02_bounded_crawl", CRAWL_SQL)
def bounded_crawl(spark, d):
    weighed = edges(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("dst"), (F.col("p_size") / 50).alias("priority")), "dst").select("src", "dst", "priority")
    return graphs.crawl(weighed, spark.range(1).toDF("node"), 3, 5, 0.5)


@query("u03_expanded_crawl", CRAWL_SQL)
def expanded_crawl(spark, d):
    """The bounded crawl with a callback that reads each reached node's links from its payload."""
    from ..operators import expansion

    weighed = edges(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("dst"), (F.col("p_size") / 50).alias("priority")), "dst")
    nodes = weighed.groupBy(F.col("src").alias("node")).agg(F.collect_list(F.struct("dst", "priority")).alias("payload"))
    expansion.register(spark, "linked_parts", lambda node, payload: ((x["dst"], x["priority"]) for x in payload))
    return expansion.crawl(nodes, spark.range(1).toDF("node"), "linked_parts", 3, 5, 0.5)


@query("g03_adjacency", f"SELECT src, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM ({EDGES}) GROUP BY src")
def adjacency(spark, d):
    return edges(spark, d).groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")).cast("array<string>"), ",").alias("neighbours"))


@query("g04_remove_node", f"SELECT src, dst FROM ({EDGES}) WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_size = 1) AND dst NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def remove_node(spark, d):
    return graphs.without_node(edges(spark, d), table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")))


@query("g05_reference_parsing", r"SELECT page_id, link, CASE WHEN regexp_matches(link, '^/[A-Z]') THEN 'paper' ELSE 'sha:' || substr(sha256(link), 1, 12) END AS ref FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages)".replace('\\"', '"'))
def reference_parsing(spark, d):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    ref = F.when(F.col("link").rlike("^/[A-Z]"), "paper").otherwise(F.concat(F.lit("sha:"), F.substring(F.sha2("link", 256), 1, 12)))
    return table(spark, d, "pages").select("page_id", links.alias("link")).select("page_id", "link", ref.alias("ref"))


@query("g06_components")
def components(spark, d):
    return graphs.connected_components(edges(spark, d))


@query("k01_bloom")
def bloom(spark, d):
    """Customers of each order in a Bloom filter of the customers with a high balance."""
    rich = table(spark, d, "customer").where("c_acctbal > 5000")
    bits, k = sketches.bloom_size(max(rich.count(), 1), 0.01)
    filt = sketches.bloom(rich, F.col("c_custkey"), bits, k)
    asked = table(spark, d, "orders").select("o_custkey").distinct()
    return sketches.might_contain(asked, F.col("o_custkey"), "o_custkey", filt, bits, k)


@query("k02_count_min")
def count_min(spark, d):
    e = table(spark, d, "events")
    return sketches.estimates(e.select("user_id").distinct(), "user_id", sketches.count_min(e, F.col("user_id")))


@query("k03_distinct_estimate")
def distinct_estimate(spark, d):
    """HyperLogLog sketches of each order priority, and of all by their union."""
    per = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.hll_sketch_agg("o_custkey", 14).alias("s"))
    return per.groupBy().agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("customers"))


@query("k04_reservoir")
def reservoir(spark, d):
    return sketches.reservoir(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, 42, "o_orderkey", F.col("o_totalprice"))


@query("k05_sketch_statistics", "SELECT CAST(ceil(-1000 * ln(0.01) / pow(ln(2), 2)) AS BIGINT) AS bits, round(1.04 / sqrt(pow(2, 14)), 8) AS hll_error")
def sketch_statistics(spark, d):
    bits, _ = sketches.bloom_size(1000, 0.01)
    return spark.range(1).select(F.lit(bits).cast("long").alias("bits"), F.round(1.04 / F.sqrt(F.pow(F.lit(2.0), F.lit(14.0))), 8).alias("hll_error"))
