"""Set operations, de-duplication and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import agglomerative, communities, density, graphs, relational, setjoin
from ..operators.folds import ordered_fold
from ..operators.state import written
from .joins import neighbour_index
from .registry import query, table

LISTS = "SELECT user_id, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY {o}, event_type) AS r FROM (SELECT user_id, event_type, sum(value) AS s, count(*) AS n FROM events GROUP BY ALL)"


@query("set01_rrf_merge", f"SELECT user_id, item, round(sum(1.0 / (60 + r)), 8) AS score FROM (({LISTS.format(o='s DESC')}) UNION ALL ({LISTS.format(o='n DESC')})) GROUP BY ALL")
def rrf_merge(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    ranked = [g.select("user_id", F.col("event_type").alias("item"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(c), "event_type")).alias("r")) for c in ("s", "n")]
    return ranked[0].unionByName(ranked[1]).groupBy("user_id", "item").agg(F.round(F.sum(1 / (60 + F.col("r"))), 8).alias("score"))


@query("set02_hybrid_candidates", "SELECT user_id, item, round(least(sum(score), 1), 6) AS score FROM (SELECT user_id, event_type AS item, 0.5 * avg(value) / 20 AS score FROM events GROUP BY ALL UNION ALL SELECT user_id, event_type, 0.3 * least(count(*) / 10, 1) FROM events GROUP BY ALL UNION ALL SELECT user_id, event_type, 0.2 * max(CASE WHEN value > 10 THEN 1 ELSE 0 END) FROM events GROUP BY ALL) GROUP BY ALL")
def hybrid_candidates(spark, d):
    """The three retrievers read the same groups, so that one pass gives all of them."""
    g = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("item")).agg((0.5 * F.avg("value") / 20).alias("a"), (0.3 * F.least(F.count("*") / 10, F.lit(1.0))).alias("b"), (0.2 * F.max(F.when(F.col("value") > 10, 1).otherwise(0))).alias("c"))
    return g.select("user_id", "item", F.round(F.least(F.col("a") + F.col("b") + F.col("c"), F.lit(1.0)), 6).alias("score"))


@query("set03_tfidf_search", r"""WITH w AS (SELECT item_id, w, count(*) AS tf FROM (SELECT item_id, unnest([x FOR x IN regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+') IF x <> '']) AS w FROM benchmark) GROUP BY ALL),
i AS (SELECT w, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM w GROUP BY w), v AS (SELECT item_id, w, tf * idf AS x FROM w JOIN i USING (w)), n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM v GROUP BY item_id)
SELECT query_id, item_id, similarity FROM (SELECT a.item_id AS query_id, b.item_id, round(sum(a.x * b.x) / (max(p.n) * max(q.n)), 6) AS similarity, row_number() OVER (PARTITION BY a.item_id ORDER BY round(sum(a.x * b.x) / (max(p.n) * max(q.n)), 6) DESC, b.item_id) AS k
 FROM v a JOIN v b USING (w) JOIN n p ON p.item_id = a.item_id JOIN n q ON q.item_id = b.item_id WHERE a.item_id % 50 = 0 GROUP BY a.item_id, b.item_id) WHERE k <= 5""")
def tfidf_search(spark, d):
    b = table(spark, d, "benchmark")
    ws = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != "")
    w = b.select("item_id", F.explode(ws).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("tf"))
    total = b.agg(F.count("*").alias("total"))
    idf = w.groupBy("w").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("w", (F.ln((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    v = w.join(idf, "w").select("item_id", "w", (F.col("tf") * F.col("idf")).alias("x"))
    norms = v.groupBy("item_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    unit = v.join(norms, "item_id").select("item_id", "w", (F.col("x") / F.col("n")).alias("x"))
    q = unit.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "w", F.col("x").alias("y"))
    sims = q.join(unit, "w").groupBy("query_id", "item_id").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("similarity"))
    return relational.top_per_group(sims, ["query_id"], [F.desc("similarity"), F.col("item_id")], 5).drop("rank")


@query("set04_ordered_union", "SELECT conv_id, string_agg(role, ',' ORDER BY pos) AS roles FROM (SELECT conv_id, role, min(turn) AS pos FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_union(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("pos"))
    return g.groupBy("conv_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda s: s["role"])).alias("roles"))


@query("set05_family_difference", "SELECT user_id, array_to_string([x FOR x IN ['click', 'error', 'purchase', 'view'] IF NOT list_contains(list(DISTINCT event_type), x)], ',') AS missing FROM events GROUP BY user_id")
def family_difference(spark, d):
    want = F.array(*map(F.lit, ("click", "error", "purchase", "view")))
    return table(spark, d, "events").groupBy("user_id").agg(F.concat_ws(",", F.array_except(want, F.collect_set("event_type"))).alias("missing"))


@query("set06_required_missing", "SELECT source, lang FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (VALUES ('en'), ('de'), ('fr'), ('es'), ('it')) AS r(lang) EXCEPT SELECT source, lang FROM documents")
def required_missing(spark, d):
    seen = table(spark, d, "documents").select("source", "lang").distinct()
    required = seen.select("source").distinct().select("source", F.explode(F.array(*map(F.lit, ("en", "de", "fr", "es", "it")))).alias("lang"))
    return required.join(seen, ["source", "lang"], "left_anti")


@query("dup01_exact_duplicates", "SELECT min(doc_id) AS primary_id, count(*) - 1 AS duplicates FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("primary_id"), (F.count("*") - 1).alias("duplicates")).where("duplicates > 0").select("primary_id", "duplicates")


@query("dup02_key_dedup", "SELECT DISTINCT source || ':' || lang AS key FROM documents")
def key_dedup(spark, d):
    return table(spark, d, "documents").select(F.concat_ws(":", "source", "lang").alias("key")).distinct()


@query("dup03_fingerprint", "SELECT doc_id, sha1(source || '||' || substr(text, 1, 64)) AS fingerprint FROM documents")
def fingerprint(spark, d):
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").select("doc_id", text.fingerprint(none, F.col("source"), none, F.col("text")).alias("fingerprint"))


@query("dup04_claim_merge")
def claim_merge(spark, d):
    """Turns of a conversation merged into the first earlier claim whose words hold at least .6 of theirs."""

    def step(kept, row):
        mine = set(row["words"])
        for k, other in enumerate(kept):
            if mine and len(mine & other) / len(mine) >= 0.6:
                return kept, {"claim": k}
        return [*kept, mine], {"claim": len(kept)}

    c = table(spark, d, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("words"))
    return ordered_fold(c, ["conv_id"], ["turn"], list, step, "claim long").select("conv_id", "turn", "claim")


@query("dup05_benchmark_rows", "SELECT p_brand, p_type, p_size, min(p_partkey) AS first FROM part GROUP BY ALL")
def benchmark_rows(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("first"))


@query("dup06_best_source", "SELECT l_suppkey AS source, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS order_id FROM lineitem GROUP BY l_suppkey")
def best_source(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("order_id"))


@query("cl01_online_clusters")
def online_clusters(spark, d):
    """Greedy clusters in order of arrival within a conversation: .4 title, .4 entity and .2 time similarity, above .3."""
    return clusters(spark, d, 0.4, 0.4, 0.2, True)


@query("cl02_event_first")
def event_first(spark, d):
    """Greedy events: .5 entity and .5 title similarity, .3 or more, earlier events first."""
    return clusters(spark, d, 0.5, 0.5, 0.0, False)


def clusters(spark, d, w_title, w_entity, w_time, strict):
    import math

    def similar(a, b):
        return len(a & b) / len(a | b) if a and b else 0.0

    def step(bundles, row):
        title, entities = set(row["title"]), set(row["entities"])
        best, at = 0.3, None
        for k, (t, e, when) in enumerate(bundles):
            s = w_title * similar(title, t) + w_entity * similar(entities, e) + w_time * math.exp(-abs(row["turn"] - when) / 48)
            if s > best or (not strict and at is None and s >= best):
                best, at = s, k
        if at is None:
            return [*bundles, (title, entities, row["turn"])], {"cluster": len(bundles)}
        t, e, when = bundles[at]
        return [*bundles[:at], (t, e | entities, max(when, row["turn"])), *bundles[at + 1 :]], {"cluster": at}

    c = table(spark, d, "conversations").select("conv_id", "turn", text.title_tokens(F.col("text")).alias("title"), F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), F.lit(0)).alias("entities"))
    return ordered_fold(c, ["conv_id"], ["turn"], list, step, "cluster long").select("conv_id", "turn", "cluster")


@query("cl03_similarity_components")
def similarity_components(spark, d):
    toks = table(spark, d, "benchmark").select("item_id", text.title_tokens(F.col("text")).alias("tokens"))
    pairs = setjoin.set_similarity_join(toks, "item_id", "tokens", 0.3)
    return graphs.connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("cl06_cluster_statistics", "SELECT label, count(*) AS size, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY label")
def cluster_statistics(spark, d):
    g = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("size"))
    return g.join(F.broadcast(g.agg(F.sum("size").alias("total")))).select("label", "size", F.round(F.col("size") / F.col("total"), 6).alias("share"))


@query("cl05_density_clusters")
def density_clusters(spark, d):
    """DBSCAN with the reference's eps .5 and min_samples 5, largest clusters first: size, density and coherence."""
    return figures(spark, d, 0.5, 5)


@query("cl05_loose_density_clusters")
def loose_density_clusters(spark, d):
    """DBSCAN with an eps at which the given vectors, which are nearly unrelated, have dense rows."""
    return figures(spark, d, 0.62, 3)


def figures(spark, d, eps, least):
    e = table(spark, d, "embeddings")
    found = density.cluster_figures(e, density.dense_clusters(neighbour_index(spark, d, links=0), eps, least))
    return found.select("component", "size", F.size("centroid").alias("dims"), F.round("density", 5).alias("density"), F.round("coherence", 5).alias("coherence"))


@query("cl07_communities")
def graph_communities(spark, d):
    """Communities among vectors linked with their ten nearest ones, weighted by similarity: size, internal and external links, share of the modularity."""
    near = neighbour_index(spark, d, links=0).near_pairs(10)
    ends = near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (1 - F.col("distance")).alias("weight"))
    edges = written(ends.groupBy("src", "dst").agg(F.max("weight").alias("weight")), "links")
    found = written(communities.communities(edges), "communities")
    return communities.modularity(edges, found).select("community", "size", "internal_edges", "external_edges", F.round("modularity", 6).alias("modularity"))


@query("cl08_ward")
def ward(spark, d):
    """Eight Ward clusters, merged along the links of each vector's ten nearest ones."""
    links = neighbour_index(spark, d, links=0).near_pairs(10).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return agglomerative.ward_clusters(table(spark, d, "embeddings"), links, 8)


@query("cl08_bisecting")
def bisecting(spark, d):
    """Top-down clusters in place of agglomerative ones, which need all pairs."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return BisectingKMeans(k=8, seed=42).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))


@query("cl07_community_edges", "SELECT a.c_nationkey = b.c_nationkey AS internal, count(*) AS edges FROM orders o JOIN customer a ON a.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN (SELECT s_suppkey, s_nationkey AS c_nationkey FROM supplier) b ON b.s_suppkey = l.l_suppkey GROUP BY ALL")
def community_edges(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a")), "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "a")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    return table(spark, d, "lineitem").join(o, "l_orderkey").join(s, "l_suppkey").groupBy((F.col("a") == F.col("b")).alias("internal")).agg(F.count("*").alias("edges"))


@query("cl04_density_tree")
def density_tree(spark, d):
    """HDBSCAN as the reference sets it: cosine distance, clusters of two rows or more, noise left out."""
    return density.tree_clusters(neighbour_index(spark, d, links=0), 2, 1)
