"""Joins, set operations, sorts, windows and changes of tables: mostly one SQL text that runs on Spark and on the oracle."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorequarry.operators import dag, federation
from lorequarry.plans.registry import both, query
from lorequarry.session import read_table

# joins
both("missing_vectors", "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {embeddings} e WHERE e.vec_id = d.doc_id)")
both("pending_embedding", "SELECT d.doc_id, e.vec_id IS NULL AS no_row FROM {documents} d LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL OR e.label = 3")
both("coarse_only", "SELECT d.doc_id, e.label FROM {documents} d JOIN {embeddings} e ON e.vec_id = d.doc_id WHERE e.label = 3")
both("edges_both_ways", """SELECT o_orderkey AS node, 'out' AS direction, c_name AS other FROM {orders} JOIN {customer} ON c_custkey = o_custkey
    UNION ALL SELECT c_custkey AS node, 'in' AS direction, CAST(o_orderkey AS STRING) AS other FROM {customer} JOIN {orders} ON c_custkey = o_custkey""")
both("representatives", """WITH own AS (SELECT c_custkey AS entity, o_orderkey AS item, 1 AS pass, o_totalprice AS w FROM {customer} JOIN {orders} ON o_custkey = c_custkey),
    best AS (SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM {supplier}) s WHERE k <= 3),
    more AS (SELECT c.c_custkey AS entity, s.s_suppkey AS item, 2 AS pass, s.s_acctbal AS w FROM {customer} c JOIN best s ON s.s_nationkey = c.c_nationkey
             WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY w DESC, item) AS rn FROM (SELECT * FROM own UNION ALL SELECT * FROM more) u)
    SELECT entity, item, pass, CAST(rn AS INT) AS rn FROM r WHERE rn <= 3""")
both("endpoint_surface", "SELECT s.s_name AS endpoint, n.n_name AS document, r.r_name AS module FROM {supplier} s LEFT JOIN {nation} n ON n.n_nationkey = s.s_nationkey LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey")
both("referential_integrity", """SELECT 'lineitem_order' AS fk, count(*) AS broken FROM {lineitem} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_orderkey = l_orderkey)
    UNION ALL SELECT 'lineitem_part', count(*) FROM {lineitem} WHERE NOT EXISTS (SELECT 1 FROM {part} WHERE p_partkey = l_partkey)
    UNION ALL SELECT 'label_document', count(*) FROM {labels} l WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id)
    UNION ALL SELECT 'vector_document', count(*) FROM {embeddings} WHERE NOT EXISTS (SELECT 1 FROM {documents} WHERE doc_id = vec_id)
    UNION ALL SELECT 'absolute_path', count(*) FROM {documents} WHERE source LIKE '/%' OR source LIKE '_:%'""")
both("ready_queue", """SELECT o_orderkey AS task, o_orderpriority AS priority FROM {orders} o WHERE o_orderstatus <> 'F'
    AND NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O' AND l.l_shipdate > o.o_orderdate + INTERVAL 60 DAYS)""")
both("queue_order", """SELECT o_orderkey AS task, CAST(row_number() OVER (ORDER BY lane, o_orderdate, o_orderkey) AS INT) AS place FROM (SELECT o_orderkey, o_orderdate, CAST(substr(o_orderpriority, 1, 1) AS INT) AS lane
    FROM {orders} WHERE o_orderstatus = 'O' ORDER BY lane, o_orderdate, o_orderkey LIMIT 100) t""")
both("dependency_listing", """SELECT a.l_orderkey AS task, a.l_linenumber AS step, b.l_linenumber AS needs, p.p_name AS title FROM {lineitem} a
    JOIN {lineitem} b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber - 1 JOIN {part} p ON p.p_partkey = b.l_partkey""")
both("dangling_relations", """SELECT l_orderkey, l_linenumber FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {part} p WHERE p.p_partkey = l.l_partkey AND p.p_size > 2)
    OR NOT EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0)""")
both("gold_indexed", "SELECT l.doc_id, l.quality FROM {labels} l WHERE EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
both("paired_arms", """SELECT a.user_id AS task, a.k AS rep, a.v AS base, b.v AS arm, round((a.v - b.v) / a.v, 4) AS saving FROM
    (SELECT user_id, CAST(ts AS DATE) AS k, sum(value) AS v FROM {events} WHERE event_type = 'view' GROUP BY user_id, CAST(ts AS DATE)) a JOIN
    (SELECT user_id, CAST(ts AS DATE) AS k, sum(value) AS v FROM {events} WHERE event_type = 'click' GROUP BY user_id, CAST(ts AS DATE)) b ON a.user_id = b.user_id AND a.k = b.k WHERE a.v > 0""")
both("unique_named", "SELECT lower(p_name) AS name, min(p_partkey) AS part, CAST(max(deg) AS BIGINT) AS degree FROM {part} LEFT JOIN (SELECT l_partkey, count(*) AS deg FROM {lineitem} GROUP BY l_partkey) d ON d.l_partkey = p_partkey GROUP BY lower(p_name) HAVING count(*) = 1")
both("verdict_match", "SELECT a.doc_id FROM {documents} a JOIN {documents} b ON a.source = b.source AND a.n_chars = b.n_chars AND a.lang = b.lang AND b.doc_id = a.doc_id + 1")
both("link_with_fallback", """WITH provides AS (SELECT DISTINCT s_nationkey AS project, p_type AS route, p_brand AS verb, CAST(p_size AS DOUBLE) / 50 AS confidence FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey),
    consumes AS (SELECT DISTINCT c_nationkey AS project, p_type AS route, p_brand AS verb FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey WHERE o_orderkey % 7 = 0),
    exact AS (SELECT c.project, c.route, c.verb, max(p.confidence) AS confidence FROM consumes c JOIN provides p ON p.route = c.route AND p.verb = c.verb AND p.project <> c.project GROUP BY c.project, c.route, c.verb),
    other AS (SELECT c.project, c.route, c.verb, max(p.confidence) AS confidence FROM consumes c JOIN provides p ON p.route = c.route AND p.verb <> c.verb AND p.project <> c.project
              WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.project = c.project AND e.route = c.route AND e.verb = c.verb) GROUP BY c.project, c.route, c.verb)
    SELECT project, route, verb, 'linked' AS state, round(confidence, 4) AS confidence FROM exact UNION ALL SELECT project, route, verb, 'divergent', round(confidence * 0.6, 4) FROM other
    UNION ALL SELECT c.project, c.route, c.verb, 'unresolved', CAST(NULL AS DOUBLE) FROM consumes c WHERE NOT EXISTS (SELECT 1 FROM provides p WHERE p.route = c.route AND p.project <> c.project)""")
both("deepest_prefix", """WITH roots AS (SELECT DISTINCT substr(url, 1, CAST(instr(url, '.') AS INT)) AS root FROM {pages} UNION SELECT 'http' AS root),
    tried AS (SELECT page_id, substr(url, 1, CAST(instr(url, '.') AS INT)) AS prefix FROM {pages} UNION ALL SELECT page_id, substr(url, 1, 4) FROM {pages})
    SELECT page_id, max_by(root, length(root)) AS root FROM tried JOIN roots ON root = prefix GROUP BY page_id""")
both("first_tool_result", """SELECT conv_id, turn, answered FROM (SELECT conv_id, turn, role, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answered FROM {conversations}) t
    WHERE role = 'user' AND answered IS NOT NULL""")

# set operations
both("union_distinct_endpoints", "SELECT o_custkey AS node FROM {orders} UNION SELECT c_custkey FROM {customer}")
both("missing_paths", "SELECT doc_id FROM {documents} WHERE doc_id % 3 <> 0 EXCEPT SELECT doc_id FROM {labels}")
both("snapshot_diff", """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'created' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change
    FROM (SELECT doc_id, n_chars FROM {documents} WHERE doc_id % 5 <> 0) a FULL OUTER JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n_chars FROM {documents} WHERE doc_id % 6 <> 0) b
    ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.n_chars <> b.n_chars""")
# an order requires the customer's order before it, and every third one also the order before that
_REQUIRES = """o AS (SELECT o_orderkey AS src, lag(o_orderkey, 1) OVER w AS a, lag(o_orderkey, 2) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    e AS (SELECT src, a AS dst FROM o WHERE a IS NOT NULL UNION ALL SELECT src, b FROM o WHERE b IS NOT NULL AND src % 3 = 0)"""


def _requires(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey", 1).over(w).alias("a"), F.lag("o_orderkey", 2).over(w).alias("b"))
    return o.select("src", F.col("a").alias("dst")).unionByName(o.where("src % 3 = 0").select("src", F.col("b").alias("dst"))).where("dst IS NOT NULL")


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"))


@query("transitive_closure", f"""WITH RECURSIVE {_REQUIRES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r""")
def transitive_closure(spark, sf_dir):
    return dag.closure(_requires(spark, sf_dir)).select("src", "dst")


@query("topological_levels", f"""WITH RECURSIVE {_REQUIRES}, r AS (SELECT o_orderkey AS node, 0 AS level FROM orders UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.node) SELECT node, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY node""")
def topological_levels(spark, sf_dir):
    return dag.levels(_orders(spark, sf_dir), _requires(spark, sf_dir))


@query("topological_order", f"""WITH RECURSIVE {_REQUIRES}, r AS (SELECT o_orderkey AS node, 0 AS level FROM orders UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.node), l AS (SELECT node, max(level) AS level FROM r GROUP BY node)
    SELECT node, row_number() OVER (ORDER BY level, node) AS place FROM l""")
def topological_order(spark, sf_dir):
    """What is required comes first, ties by key."""
    return dag.topological(_orders(spark, sf_dir), _requires(spark, sf_dir)).select("node", "place")


@query("cycle_detection", f"""WITH RECURSIVE {_REQUIRES}, f AS (SELECT o_custkey AS c, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY o_custkey),
    k AS (SELECT DISTINCT a.first AS src, b.last AS dst FROM f a JOIN f b ON b.c = a.c + a.c % 2), r AS (SELECT src, dst, dst AS node, 1 AS n FROM k WHERE src <> dst UNION SELECT r.src, r.dst, e.dst, n + 1 FROM r JOIN e ON e.src = r.node)
    SELECT k.src, k.dst, CAST(CASE WHEN k.src = k.dst THEN 1 ELSE min(r.n) END AS INTEGER) AS length FROM k LEFT JOIN r ON r.src = k.src AND r.dst = k.dst AND r.node = k.src GROUP BY k.src, k.dst""")
def cycle_detection(spark, sf_dir):
    """Would a customer's first order close a cycle by requiring their last one, or (odd keys) the next customer's?"""
    key = F.struct("o_orderdate", "o_orderkey")
    ends = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.min_by("o_orderkey", key).alias("first"), F.max_by("o_orderkey", key).alias("last"))
    asked = ends.select((F.col("c") + F.col("c") % 2).alias("c"), F.col("first").alias("src")).join(ends.select("c", F.col("last").alias("dst")), "c").select("src", "dst")
    found = dag.closed_cycles(_requires(spark, sf_dir), asked)
    return found.select("src", "dst", (F.size("path") - 1).alias("length")).withColumn("length", F.when(F.col("length") > 0, F.col("length")))


# windows, sorts and limits
both("neighbour_rows", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM {conversations}")
both("top_symbols_per_group", "SELECT p_brand, p_name, CAST(rn AS INT) AS rn FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name, p_partkey) AS rn FROM {part}) t WHERE rn <= 3")
both("prefix_budget", """SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM {documents}) t WHERE used <= 50000""")
both("latest_per_task", "SELECT user_id, max_by(event_type, event_id) AS last_type, max(event_id) AS last_event FROM {events} GROUP BY user_id")
both("latest_events", "SELECT user_id, event_id, CAST(rn AS INT) AS rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) t WHERE rn <= 5")
both("run_history_page", "SELECT o_orderkey, o_orderdate, o_totalprice FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
both("severity_order", "SELECT event_type, CAST(CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS INT) AS severity, count(*) AS n FROM {events} GROUP BY event_type ORDER BY severity DESC, event_type")
both("eviction", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS bytes FROM {documents}) t WHERE n > 20 OR bytes > 60000""")
both("ordered_distinct", "SELECT lang, min(doc_id) AS first_seen FROM {documents} GROUP BY lang")
both("stable_tiebreak", """SELECT c_custkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal, -2) DESC, c_custkey) AS INT) AS place FROM {customer}""")
both("latest_write_wins", """SELECT doc_id, n_chars, version FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS rn FROM (SELECT doc_id, n_chars, 1 AS version FROM {documents} UNION ALL SELECT doc_id, n_chars + 1, 2 FROM {documents} WHERE doc_id % 4 = 0) u) t WHERE rn = 1""")

# filters and lookups
both("id_prefix_lookup", """SELECT c_custkey, c_name, count(*) OVER () > 1 AS ambiguous FROM (SELECT c_custkey, c_name FROM {customer} WHERE c_name LIKE 'Customer#00000001%' ORDER BY c_custkey LIMIT 2) t""")
both("entity_lookup_tiers", """WITH a AS (SELECT p_partkey, p_name, CASE WHEN CAST(p_partkey AS STRING) = 'red widget' THEN 1 WHEN lower(p_name) = 'red widget' THEN 2 WHEN lower(p_name) LIKE '%widget%' THEN 3 ELSE 4 END AS tier FROM {part})
    SELECT p_partkey, p_name, tier FROM a WHERE tier < 4 AND tier = (SELECT min(tier) FROM a)""")
both("optional_predicates", "SELECT doc_id, lang FROM {documents} WHERE 1 = 1 AND lang = 'de' AND n_chars BETWEEN 500 AND 5000")
both("test_path_exclusion", "SELECT page_id FROM {pages} WHERE url NOT LIKE '%/de/%' AND url NOT LIKE '%#top' AND url NOT LIKE '%utm_%'")
both("private_hidden", "SELECT s_suppkey, s_name FROM {supplier} WHERE CASE WHEN s_suppkey % 4 = 0 THEN 'private' ELSE 'public' END <> 'private'")
both("find_contract", "SELECT p_brand, max(p_retailprice) AS confidence, max_by(p_partkey, CASE WHEN p_retailprice IS NOT NULL THEN (p_retailprice, -p_partkey) END) AS handler FROM {part} WHERE lower(p_brand) = lower('BRAND#1') OR lower(p_brand) = lower('Brand#12') GROUP BY p_brand")
both("size_cap", "SELECT doc_id, n_chars > 5000 AS too_large FROM {documents}")
both("batched_in_list", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size > 45)")
both("worktree_intersection", "SELECT n_chars, lang FROM {documents} WHERE doc_id % 2 = 0 INTERSECT SELECT n_chars, lang FROM {documents} WHERE doc_id % 2 = 1")
both("scope_filter", "SELECT doc_id, source FROM {documents} WHERE source IS NULL OR ((source LIKE 'src1%' OR source LIKE 'src2%') AND source NOT LIKE '%9')")

# changes of tables
both("replace_chunks", """SELECT count(CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL AND o.v = n.v THEN 1 END) AS kept, count(CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL AND o.v <> n.v THEN 1 END) AS updated,
    count(CASE WHEN o.id IS NULL THEN 1 END) AS added, count(CASE WHEN n.id IS NULL THEN 1 END) AS removed
    FROM (SELECT doc_id AS id, n_chars AS v FROM {documents} WHERE doc_id % 3 <> 0) o FULL OUTER JOIN (SELECT doc_id AS id, n_chars + doc_id % 2 AS v FROM {documents} WHERE doc_id % 5 <> 0) n ON o.id = n.id""")
both("delete_by_path", "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
both("insert_or_ignore", "SELECT vec_id AS id, 'local' AS origin FROM {embeddings} UNION ALL SELECT doc_id, 'incoming' FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {embeddings} e WHERE e.vec_id = d.doc_id)")
both("orphan_checks", """SELECT 'orders_without_lines' AS kind, count(*) AS n FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey)
    UNION ALL SELECT 'customers_without_orders', count(*) FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)
    UNION ALL SELECT 'parts_never_sold', count(*) FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey)
    UNION ALL SELECT 'documents_without_label', count(*) FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'documents_without_vector', count(*) FROM {documents} WHERE NOT EXISTS (SELECT 1 FROM {embeddings} WHERE vec_id = doc_id)
    UNION ALL SELECT 'nations_without_customers', count(*) FROM {nation} WHERE NOT EXISTS (SELECT 1 FROM {customer} WHERE c_nationkey = n_nationkey)""")
both("import_merge", "SELECT doc_id, 1 AS quality, 'local' AS origin FROM {documents} WHERE doc_id % 2 = 0 UNION ALL SELECT l.doc_id, l.quality, 'incoming' FROM {labels} l WHERE l.doc_id % 2 <> 0")
both("run_bookkeeping", "SELECT user_id, min(ts) AS started, max(ts) AS finished, count(*) AS steps, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed FROM {events} GROUP BY user_id")
both("next_attempt", "SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_attempt FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey")


# suppliers' nations provide part types under a brand as verb, customers' nations consume them
_FED_SQL = """i AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS project, 'provides' AS direction, replace(p_brand, ' ', '') || ' /' || replace(p_type, ' ', '/') || '/' || p_partkey % 40 AS normalized, CAST(p_size AS DOUBLE) / 50 AS confidence, p_size % 3 = 0 AS contract
          FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
          UNION SELECT CAST(c_nationkey AS VARCHAR), 'consumes', replace(p_brand, ' ', '') || ' /' || replace(p_type, ' ', '/') || '/' || p_partkey % 40, 1.0, false FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
    p AS (SELECT project, normalized, substr(normalized, instr(normalized, ' ') + 1) AS route, max(confidence) AS confidence, bool_or(contract) AS contract FROM i WHERE direction = 'provides' GROUP BY project, normalized),
    c AS (SELECT DISTINCT project, normalized, substr(normalized, instr(normalized, ' ') + 1) AS route FROM i WHERE direction = 'consumes')"""


def _contracts(spark, sf_dir):
    t = {n: read_table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier", "orders", "customer")}
    squeezed = lambda c, by: F.replace(c, F.lit(" "), F.lit(by))
    name = F.concat(squeezed("p_brand", ""), F.lit(" /"), squeezed("p_type", "/"), F.lit("/"), F.col("p_partkey") % 40)
    lines = t["lineitem"].select("l_orderkey", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).join(t["part"].select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey")
    item = lambda df, project, direction, confidence, contract: df.select(F.col(project).cast("string").alias("project"), F.lit("http").alias("kind"), F.lit(direction).alias("direction"), name.alias("normalized"), confidence.alias("confidence"), contract.alias("contract")).distinct()
    sold = item(lines.join(t["supplier"].select("s_suppkey", "s_nationkey"), "s_suppkey"), "s_nationkey", "provides", F.col("p_size").cast("double") / 50, F.col("p_size") % 3 == 0)
    bought = lines.join(t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(t["customer"].select("c_custkey", "c_nationkey"), "c_custkey")
    return sold.unionByName(item(bought, "c_nationkey", "consumes", F.lit(1.0), F.lit(False)))


@query("federation_links", f"""WITH {_FED_SQL},
    m AS (SELECT c.project, c.normalized, p.project AS provider, CASE WHEN p.contract THEN 1.0 ELSE 0.95 END AS confidence, row_number() OVER (PARTITION BY c.project, c.normalized ORDER BY p.confidence DESC, p.project) AS r FROM c JOIN p ON p.normalized = c.normalized AND p.project <> c.project),
    n AS (SELECT route, project, max(confidence) AS confidence FROM p GROUP BY route, project),
    d AS (SELECT c.project, c.normalized, n.project AS provider, row_number() OVER (PARTITION BY c.project, c.normalized ORDER BY n.confidence DESC, n.project) AS r FROM c JOIN n ON n.route = c.route AND n.project <> c.project)
    SELECT c.project, c.normalized, CASE WHEN m.provider IS NOT NULL THEN 'linked' WHEN d.provider IS NOT NULL THEN 'divergent' ELSE 'unresolved' END AS state, coalesce(m.provider, d.provider) AS provider, CAST(m.confidence AS DOUBLE) AS confidence
    FROM c LEFT JOIN m ON m.project = c.project AND m.normalized = c.normalized AND m.r = 1 LEFT JOIN d ON d.project = c.project AND d.normalized = c.normalized AND d.r = 1""")
def federation_links(spark, sf_dir):
    """Every consumed contract with its provider in another project, its divergence, or neither."""
    return federation.link(_contracts(spark, sf_dir)).select("project", "normalized", "state", "provider", "confidence")


@query("contract_scores", f"""WITH {_FED_SQL}, h AS (SELECT DISTINCT project, normalized, confidence, unnest(list_distinct(regexp_extract_all(lower(normalized), '[\\p{{L}}\\p{{N}}]+'))) AS w FROM p),
    s AS (SELECT n_nationkey, n_name || ' standard brass ' || n_regionkey AS text FROM nation), a AS (SELECT n_nationkey AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS w, len(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS k FROM s)
    SELECT query_id, project, normalized, round(count(*) / k * max(confidence), 6) AS score FROM h JOIN a USING (w) GROUP BY query_id, k, project, normalized""")
def contract_scores(spark, sf_dir):
    """Shared words of a question and a contract's name, times its confidence."""
    items = _contracts(spark, sf_dir).where("direction = 'provides'")
    best = items.groupBy("project", "kind", "normalized").agg(F.max("confidence").alias("confidence"))
    asked = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat("n_name", F.lit(" standard brass "), "n_regionkey").alias("text"))
    return federation.contract_search(best, asked).select("query_id", "project", "normalized", "score")
