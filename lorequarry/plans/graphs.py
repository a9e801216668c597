"""Graph queries over customers, orders, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorequarry.operators import graph as G
from lorequarry.plans.registry import both, query
from lorequarry.plans.search import BM25_SQL, keyword
from lorequarry.session import cut, read_table

both("graph_extraction", "SELECT 'contains' AS type, n_regionkey AS src, n_nationkey AS dst FROM {nation} UNION ALL SELECT 'calls', c_nationkey, c_custkey FROM {customer} UNION ALL SELECT 'mentions', s_nationkey, s_suppkey FROM {supplier}")
both("edges_between_entities", "SELECT l_orderkey, l_partkey FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size < 25) AND l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'O')")
both("confidence_tiers", "SELECT CASE WHEN l_discount <= 0.05 THEN 'extracted' ELSE 'inferred' END AS tier, count(*) AS n FROM {lineitem} GROUP BY 1")
both("technology_detection", "SELECT tech, max(confidence) AS confidence FROM (SELECT lang AS tech, CAST(1.0 AS DOUBLE) AS confidence FROM {documents} WHERE n_chars > 20000 UNION ALL SELECT lang, CAST(0.95 AS DOUBLE) FROM {documents} UNION ALL SELECT source, CAST(0.9 AS DOUBLE) FROM {documents}) t GROUP BY tech")
both("layer_clear", "SELECT p_partkey FROM {part} WHERE p_type NOT IN (SELECT p_type FROM {part} WHERE p_size = 1) OR p_brand = 'Brand#11'")
both("seed_entities", """WITH top AS (SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM {documents}) t WHERE rn <= 10)
    SELECT coalesce(l.doc_id, top.doc_id) AS entity, CASE WHEN l.doc_id IS NULL THEN 'file' ELSE 'symbol' END AS kind, max(top.n_chars) AS score FROM top LEFT JOIN {labels} l ON l.doc_id = top.doc_id GROUP BY 1, 2""")
both("name_resolution", """SELECT c.conv_id, c.turn, p.part FROM {conversations} c JOIN (SELECT lower(p_brand) AS brand, min(p_partkey) AS part FROM {part} GROUP BY lower(p_brand)) p ON p.brand = lower('brand#' || c.turn || c.turn) AND p.part <> c.conv_id""")
both("repo_map_budget", """SELECT nation, node, CAST(used AS BIGINT) AS used FROM (SELECT nation, node, sum(n) OVER (PARTITION BY nation ORDER BY degree DESC, node ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT s_nationkey AS nation, s_suppkey AS node, length(s_name) + 10 AS n, d.degree FROM {supplier}
    JOIN (SELECT l_suppkey, count(*) AS degree FROM {lineitem} GROUP BY l_suppkey) d ON d.l_suppkey = s_suppkey) t) u WHERE used <= 90""")
both("neighbors_two_way", "SELECT DISTINCT l_suppkey AS node, l_partkey AS other, 'out' AS direction FROM {lineitem} UNION ALL SELECT DISTINCT l_partkey, l_suppkey, 'in' FROM {lineitem}")
both("ranked_files", "SELECT p_brand AS file, p_name AS symbol, CAST(rn AS INT) AS rn, degree FROM (SELECT p_brand, p_name, degree, row_number() OVER (PARTITION BY p_brand ORDER BY degree DESC, p_name, p_partkey) AS rn FROM {part} JOIN (SELECT l_partkey, count(*) AS degree FROM {lineitem} GROUP BY l_partkey) d ON d.l_partkey = p_partkey) t WHERE rn <= 3")


def trade(spark, sf_dir):
    """Edges customer nation -> supplier nation, weighted by quantity."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    bought = lines.join(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sold = bought.join(read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return sold.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))


@query("pagerank")
def pagerank(spark, sf_dir):
    return G.pagerank(trade(spark, sf_dir)).select("node", F.round("rank", 6).alias("rank"))


@query("bfs_expand")
def bfs_expand(spark, sf_dir):
    """Nodes within two hops of the ten smallest parts in the part-supplier graph."""
    pairs = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("weight"))
    edges = pairs.select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("rid"), F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst"), (F.least("weight", F.lit(3)) / 3.0).alias("weight"))
    seeds = edges.select(F.col("src").alias("node")).distinct().orderBy("node").limit(10).withColumn("score", F.lit(1.0))
    return G.expand(edges, seeds).select("node", F.round("score", 9).alias("score"), "depth")


@query("graph_upsert", "SELECT l_partkey AS id, max(l_quantity) AS weight, max(l_discount) AS confidence, min_by(CASE WHEN l_tax > 0.04 THEN l_returnflag END, CASE WHEN l_tax > 0.04 THEN l_orderkey * 10 + l_linenumber END) AS summary FROM lineitem GROUP BY l_partkey")
def graph_upsert(spark, sf_dir):
    summary = F.when(F.col("l_tax") > 0.04, F.col("l_returnflag"))
    return G.upsert(read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("weight"), F.col("l_discount").alias("confidence"), summary.alias("summary"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")))


@query("graph_search", f"""WITH {BM25_SQL}, b AS (SELECT query_id, doc_id, rank FROM kr WHERE rank <= 10),
    e AS (SELECT 's:' || source AS s, 'l:' || lang AS l, CAST(count(*) AS DOUBLE) / (count(*) + 10) AS w FROM documents GROUP BY source, lang),
    dg AS (SELECT s AS node, count(*) AS g FROM e GROUP BY s UNION ALL SELECT l, count(*) FROM e GROUP BY l),
    m AS (SELECT 's:' || source AS node, doc_id, n_chars FROM documents UNION ALL SELECT 'l:' || lang, doc_id, n_chars FROM documents),
    h0 AS (SELECT query_id, node, max(1.0E0 / rank) AS score FROM b JOIN m USING (doc_id) WHERE rank <= 5 AND starts_with(node, 's:') GROUP BY query_id, node),
    h1 AS (SELECT query_id, l AS node, max(score * 0.6E0 * w / ln(g + exp(1.0E0))) AS score FROM h0 JOIN e ON s = h0.node JOIN dg ON dg.node = l GROUP BY query_id, l),
    h2 AS (SELECT query_id, s AS node, max(score * 0.36E0 * w / ln(g + exp(1.0E0))) AS score FROM h1 JOIN e ON l = h1.node JOIN dg ON dg.node = s GROUP BY query_id, s),
    x AS (SELECT * FROM h1 UNION ALL SELECT h2.* FROM h2 LEFT JOIN h0 ON h0.query_id = h2.query_id AND h0.node = h2.node WHERE h2.score > coalesce(h0.score, 0)),
    t AS (SELECT node, doc_id FROM (SELECT node, doc_id, row_number() OVER (PARTITION BY node ORDER BY n_chars DESC, doc_id) AS r FROM m) z WHERE r <= 2),
    f AS (SELECT query_id, doc_id, round(max(score), 9) AS score FROM x JOIN t USING (node) GROUP BY query_id, doc_id),
    a AS (SELECT 'hybrid' AS via, query_id, doc_id, rank FROM b UNION ALL SELECT 'graph', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM f)
    SELECT query_id, doc_id, round(sum(CASE via WHEN 'hybrid' THEN 1.0 ELSE 0.7 END / (60 + rank)), 6) AS score, string_agg(DISTINCT via, ',' ORDER BY via) AS matched_by FROM a GROUP BY query_id, doc_id""")
def graph_search(spark, sf_dir):
    """Sources of the first five keyword hits, the languages they share with other sources, and documents of both."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("n_chars").alias("weight"))
    source, lang = F.concat(F.lit("s:"), "source").alias("node"), F.concat(F.lit("l:"), "lang").alias("node")
    n = F.count("*")
    edges = cut(docs.groupBy("source", "lang").agg((n / (n + 10)).alias("weight")).select(F.concat_ws(" ", "source", "lang").alias("rid"), source.alias("src"), lang.alias("dst"), "weight"))
    named = docs.select(source, "doc_id", "weight")
    return G.search(cut(keyword(spark, sf_dir, 10)), named, edges, 5, docs.select(lang, "doc_id", "weight")).select("query_id", "doc_id", F.round("score", 6).alias("score"), "matched_by")
