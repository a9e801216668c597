"""Task orchestration queries over orders, lines and events."""

from __future__ import annotations

from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from lorequarry.operators import decompose as D
from lorequarry.operators import tasks as K
from lorequarry.plans.registry import both, query
from lorequarry.session import read_table

both("state_machine_check", """WITH allowed AS (SELECT 'O' AS a, 'P' AS b UNION ALL SELECT 'P', 'F' UNION ALL SELECT 'O', 'F'), moves AS (SELECT o_custkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, o_orderstatus AS b FROM {orders})
    SELECT a, b, count(*) AS n FROM moves WHERE a IS NOT NULL AND a <> b AND NOT EXISTS (SELECT 1 FROM allowed WHERE allowed.a = moves.a AND allowed.b = moves.b) GROUP BY a, b""")
both("lease_expiry", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P' AND o_orderdate + INTERVAL 900 DAYS < (SELECT max(o_orderdate) FROM {orders})")
both("promote_dependents", "SELECT b.l_orderkey, b.l_linenumber FROM {lineitem} a JOIN {lineitem} b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O'")
both("result_validation", "SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.quality = 0 THEN 'rejected' WHEN d.source NOT LIKE 'src1%' THEN 'scope' ELSE 'ok' END AS result FROM {labels} l LEFT JOIN {documents} d ON d.doc_id = l.doc_id")
both("track_edges", "SELECT DISTINCT o_orderpriority AS track, o_orderstatus AS needs FROM {orders}")
both("impact_measure", "SELECT lang, least(100, count(DISTINCT source) * 5) AS impact FROM {documents} WHERE n_chars > 2000 GROUP BY lang")
both("rehydrated_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 = 0 THEN 'pending' ELSE o_orderstatus END AS status FROM {orders}")
both("status_panel", "SELECT o_orderpriority AS lane, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS running, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished FROM {orders} GROUP BY o_orderpriority")
both("interval_next_run", "SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN ts + INTERVAL 300 SECONDS ELSE ts + INTERVAL 1 HOURS END AS next_run FROM {events}")
both("signal_scores", """SELECT conv_id, turn, CAST((CASE WHEN text LIKE '%tion%' THEN 25 ELSE 0 END) + (CASE WHEN text LIKE '%the%' THEN 15 ELSE 0 END) + (CASE WHEN length(text) > 400 THEN 20 ELSE 0 END) - (CASE WHEN text LIKE '%and%' THEN 10 ELSE 0 END) AS INT) AS score FROM {conversations}""")


def dimensions():
    n, k = F.col("n_chars").cast("double"), F.col("doc_id")
    return {"complexity": F.least(F.lit(100.0), F.floor(n / 200).cast("double")), "architecture": ((k % 5) * 15).cast("double"), "business_rule": ((k % 3) * 20).cast("double"), "dependency": ((k % 2) * 30).cast("double"), "risk": ((k % 7) * 10).cast("double"), "security": F.lit(0.0), "documentation": ((k % 4) * 12).cast("double")}


_DIMS = {"complexity": "least(100.0, floor(CAST(n_chars AS DOUBLE) / 200))", "architecture": "CAST(doc_id % 5 * 15 AS DOUBLE)", "business_rule": "CAST(doc_id % 3 * 20 AS DOUBLE)", "dependency": "CAST(doc_id % 2 * 30 AS DOUBLE)", "risk": "CAST(doc_id % 7 * 10 AS DOUBLE)", "security": "CAST(0 AS DOUBLE)", "documentation": "CAST(doc_id % 4 * 12 AS DOUBLE)"}
_ACTIVE = " + ".join(f"CASE WHEN {k} > 0 THEN 1.0 ELSE 0.0 END" for k in _DIMS)
_SUM = " + ".join(f"CASE WHEN {k} > 0 THEN {k} * CAST({K.WEIGHTS[k]} AS DOUBLE) ELSE 0 END" for k in _DIMS)
_WEIGHT = " + ".join(f"CASE WHEN {k} > 0 THEN CAST({K.WEIGHTS[k]} AS DOUBLE) ELSE 0 END" for k in _DIMS)


@query("task_score", f"""WITH d AS (SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in _DIMS.items())} FROM documents)
    SELECT doc_id, CAST(round_even(least(100.0, CAST(0.55 AS DOUBLE) * greatest({", ".join(f"{k} * CAST({K.WEIGHTS[k]} AS DOUBLE)" for k in _DIMS)}) / CAST(1.3 AS DOUBLE) + CAST(0.20 AS DOUBLE) * ({_SUM}) / ({_WEIGHT}) + CAST(30.0 AS DOUBLE) * ({_ACTIVE}) / 7), 0) AS INTEGER) AS score FROM d WHERE ({_ACTIVE}) > 0""")
def task_score(spark, sf_dir):
    scored = read_table(spark, sf_dir, "documents").select("doc_id", K.total_score(dimensions()).alias("score"))
    return scored.where("score > 0")


@query("task_bands")
def task_bands(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").groupBy(K.band(K.total_score(dimensions())).alias("band")).agg(F.count("*").alias("n"))


@query("merged_status", """SELECT event_id, CASE WHEN list_position(p, a) >= list_position(p, b) THEN a ELSE b END AS status FROM (SELECT event_id, ['pending', 'ready', 'queued', 'blocked', 'waiting_approval', 'running', 'retrying', 'failed', 'completed', 'cancelled'] AS p,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'ready' ELSE 'running' END AS a, CASE user_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' ELSE 'cancelled' END AS b FROM events) t""")
def merged_status(spark, sf_dir):
    e, u = F.col("event_type"), F.col("user_id") % 3
    a = F.when(e == "error", "failed").when(e == "view", "ready").otherwise("running")
    b = F.when(u == 0, "completed").when(u == 1, "pending").otherwise("cancelled")
    return read_table(spark, sf_dir, "events").select("event_id", K.merged_status(a, b).alias("status"))


@query("backoff_due", "SELECT event_id, ts + to_seconds(CASE least(user_id % 5 + 1, 3) WHEN 1 THEN 30 WHEN 2 THEN 120 ELSE 600 END) AS due FROM events WHERE event_type = 'error'")
def backoff_due(spark, sf_dir):
    due = F.col("ts") + F.make_dt_interval(secs=K.backoff(F.col("user_id") % 5 + 1).cast("decimal(18,6)"))
    return read_table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", due.alias("due"))


@query("cron_next_fire", """SELECT event_id, CAST((SELECT min(g) FROM (SELECT unnest(generate_series(date_trunc('minute', ts) + INTERVAL 1 MINUTE, date_trunc('minute', ts) + INTERVAL 8 DAYS, INTERVAL 1 MINUTE)) AS g) s
    WHERE extract(minute FROM g) IN (0, 20, 40) AND extract(hour FROM g) BETWEEN 8 AND 10 AND extract(dow FROM g) IN (1, 3, 5)) AS VARCHAR) AS fires FROM events WHERE user_id = 1""")
def cron_next_fire(spark, sf_dir):
    """Of one client's events: the reference SQL walks every minute, so the check stays on a key of the data."""
    rows = read_table(spark, sf_dir, "events").where("user_id = 1")
    return rows.select("event_id", F.date_format(K.cron_next("*/20 8-10 * * 1,3,5", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("fires"))


#: A catalogue over words of this corpus: (rule, dimension, weight, words, hard), and types of documents (type, requires, triggers, from).
_RULES = (
    ("data", "architecture", 50, "les|der|was", False), ("erase", "risk", 75, "queque|nicht|thing", True), ("login", "security", 65, "pas|auch|for", False),
    ("performance", "complexity", 35, "le|die|and", False), ("price", "business_rule", 55, "pour|sch|ing", False), ("rename", "complexity", -30, "une|ein|of", False),
    ("service", "architecture", 35, "des|das|that", False), ("typo", "complexity", -60, "avec|zu|with", False), ("vault", "security", 45, "dans|von|is", True),
)
_TYPES = (("decision", (), ("architecture",), 50), ("design", ("decision", "scope"), ("complexity", "risk"), 70), ("scope", (), ("business_rule",), 50), ("threats", ("design",), ("security",), 60))
_AROUND = r"(^|[ .,;:\n])(%s)($|[ .,;:\n])"


def rule_rows(spark):
    made = [(rule, dimension, weight, _AROUND % words, hard) for rule, dimension, weight, words, hard in _RULES]
    return D.catalogue(spark.createDataFrame(made, "rule string, dimension string, weight int, pattern string, hard boolean"), "rule")


def type_rows():
    return [Row(type=t, requires=list(needs), triggers=list(triggers), min_score=least) for t, needs, triggers, least in _TYPES]


def requests(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), "text")


def first_word(text):
    return F.lower(F.regexp_extract(text, r"^([^ .,\n]+)", 1))


def keyword_hits(spark, sf_dir):
    """Up to twelve documents that begin with a request's first word; the best of a word are ranked before they meet requests."""
    path = F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".py"))
    words = read_table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), first_word(F.col("text")).alias("word")).where("word <> ''")
    best = words.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("doc_id"))).where("place <= 12")
    return requests(spark, sf_dir).select("request_id", first_word(F.col("text")).alias("word")).join(best, "word").select("request_id", "path")


def assessed(spark, sf_dir):
    return D.assess(requests(spark, sf_dir), rule_rows(spark), D.impact(keyword_hits(spark, sf_dir)))


_SCORES = {d: f"coalesce(sum(weight) FILTER (dimension = '{d}'), 0)" for d in K.WEIGHTS}
_PEAK = ", ".join(f"{d} * CAST({w} AS DOUBLE)" for d, w in K.WEIGHTS.items())
_BREADTH = " + ".join(f"CASE WHEN {d} > 0 THEN 1 ELSE 0 END" for d in K.WEIGHTS)
_VALUES = ", ".join(f"""('{r}', '{d}', {w}, '(^|[ .,;:\\n])({p})($|[ .,;:\\n])', {h})""" for r, d, w, p, h in _RULES)
_ASSESSED = rf"""rules(rule, dimension, weight, pattern, hard) AS (VALUES {_VALUES}),
    r AS (SELECT conv_id || ':' || turn AS request_id, text, lower(regexp_extract(text, '^([^ .,\n]+)', 1)) AS word FROM conversations WHERE role = 'user'),
    b AS (SELECT * FROM (SELECT lower(regexp_extract(text, '^([^ .,\n]+)', 1)) AS word, source AS module, doc_id % 3 = 0 AS doc, row_number() OVER (PARTITION BY lower(regexp_extract(text, '^([^ .,\n]+)', 1)) ORDER BY doc_id) AS place FROM documents) t WHERE word <> '' AND place <= 12),
    m AS (SELECT request_id, least(100, count(DISTINCT module) * 12 + count(*) FILTER (NOT doc) * 3) AS dep, CASE WHEN count(*) FILTER (doc) = 0 THEN 60 ELSE greatest(0, 40 - count(*) FILTER (doc) * 12) END AS docs FROM r JOIN b USING (word) GROUP BY request_id),
    f AS (SELECT r.request_id, coalesce(string_agg(rule, ',' ORDER BY rule), '') AS fired, {", ".join(f"{v} AS {k}" for k, v in _SCORES.items())}, max(weight) FILTER (weight > 0) AS up, -min(weight) FILTER (weight < 0) AS down,
        coalesce(bool_or(hard AND dimension = 'security'), false) AS hard_s, coalesce(bool_or(hard AND dimension = 'risk'), false) AS hard_r FROM r LEFT JOIN rules ON regexp_matches(text, pattern) GROUP BY r.request_id),
    t AS (SELECT f.*, down IS NOT NULL AND (up IS NULL OR up < 40 OR down >= up) AS trivial, down IS NOT NULL AS damped, coalesce(dep, 0) AS dep, coalesce(docs, 60) AS docs FROM f LEFT JOIN m ON m.request_id = f.request_id),
    c AS (SELECT * REPLACE ({", ".join(f"greatest(0, least(100, {d}" + {"dependency": " + CASE WHEN trivial THEN 0 ELSE dep END", "documentation": " + CASE WHEN trivial THEN 0 ELSE docs END"}.get(d, "") + f")) AS {d}" for d in K.WEIGHTS)}) FROM t),
    s AS (SELECT *, {_BREADTH} AS breadth, CASE WHEN trivial OR {_BREADTH} = 0 THEN 0 ELSE round_even(least(100.0, CAST(0.55 AS DOUBLE) * greatest({_PEAK}) / CAST(1.3 AS DOUBLE)
        + CAST(0.20 AS DOUBLE) * ({" + ".join(f"{d} * CAST({w} AS DOUBLE)" for d, w in K.WEIGHTS.items())}) / ({" + ".join(f"CASE WHEN {d} > 0 THEN CAST({w} AS DOUBLE) ELSE 0 END" for d, w in K.WEIGHTS.items())}) + CAST(30.0 AS DOUBLE) * ({_BREADTH}) / 7), 0) END AS whole FROM c),
    v AS (SELECT *, CAST(CASE WHEN damped THEN round_even(whole * CAST(0.6 AS DOUBLE), 0) ELSE whole END AS INTEGER) AS total, NOT trivial AND ((security >= 60 AND (hard_s OR NOT damped)) OR (risk >= 70 AND (hard_r OR NOT damped))) AS lifted FROM s),
    l AS (SELECT *, CASE WHEN total <= 25 THEN 1 WHEN total <= 50 THEN 2 WHEN total <= 75 THEN 3 ELSE 4 END AS base FROM v),
    k AS (SELECT *, greatest(CASE WHEN base = 1 AND security >= 40 AND (hard_s OR NOT trivial) THEN 2 ELSE base END, CASE WHEN lifted THEN 3 ELSE 1 END) AS level, base >= 3 OR lifted AS requires_documentation,
        base = 4 OR ((base >= 3 OR lifted) AND breadth >= 4) AS requires_decomposition, (security >= 50 AND NOT trivial) OR risk >= 60 AS requires_approval, greatest(security, architecture, business_rule) AS foremost FROM l),
    a AS (SELECT *, ['direct', 'analysis', 'documentation', 'decomposition'][level] AS band FROM k)"""
_PLANNED = """d AS (SELECT *, array_to_string(list_filter([CASE WHEN architecture >= 50 OR deep THEN 'decision' END, CASE WHEN business_rule >= 50 OR deep THEN 'scope' END, CASE WHEN deep THEN 'design' END, CASE WHEN security >= 60 THEN 'threats' END], lambda x: x IS NOT NULL), ',') AS documents
        FROM (SELECT *, complexity >= 70 OR risk >= 70 OR security >= 60 AS deep FROM a) t),
    tracks(place, track, type, priority, dimension, least) AS (VALUES (1, 'analysis', 'analysis', 'high', NULL, 0), (2, 'documentation', 'documentation', 'high', NULL, 0), (3, 'database', 'technical', 'high', 'architecture', 45), (4, 'backend', 'technical', 'high', NULL, 0),
        (5, 'integration', 'integration', 'medium', 'architecture', 50), (6, 'frontend', 'technical', 'medium', 'business_rule', 50), (7, 'tests', 'testing', 'high', NULL, 0), (8, 'security', 'security', 'high', 'security', 40),
        (9, 'performance', 'performance', 'medium', 'complexity', 60), (10, 'deploy', 'deployment', 'medium', 'risk', 50), (11, 'observability', 'operations', 'medium', 'risk', 50), (12, 'validation', 'validation', 'high', NULL, 0)),
    n AS (SELECT request_id, requires_approval, documents, track, type, priority, row_number() OVER (PARTITION BY request_id ORDER BY place) AS seq FROM d CROSS JOIN tracks WHERE CASE WHEN track = 'documentation' THEN documents <> ''
        ELSE dimension IS NULL OR CASE dimension WHEN 'architecture' THEN architecture WHEN 'business_rule' THEN business_rule WHEN 'security' THEN security WHEN 'complexity' THEN complexity ELSE risk END >= least END)"""


@query("request_assessment", f"""WITH {_ASSESSED} SELECT request_id, fired, total, trivial, band, CASE WHEN trivial OR level = 1 THEN 'direct' WHEN fired = '' THEN 'unknown' WHEN foremost >= 50 AND foremost >= greatest({", ".join(K.WEIGHTS)}) - 5 THEN CASE foremost WHEN security THEN 'security' WHEN architecture THEN 'architecture' ELSE 'product' END
    WHEN fired LIKE '%performance%' AND complexity >= 30 THEN 'performance' ELSE band END AS nature, requires_documentation, requires_decomposition, requires_approval,
    CASE WHEN requires_decomposition THEN 'document, decompose, execute' WHEN requires_documentation THEN 'document, execute' WHEN level = 2 THEN 'analyze, execute' ELSE 'execute' END AS strategy FROM a""")
def request_assessment(spark, sf_dir):
    """Every user turn judged as a request, with the impact that its keyword hits measure."""
    return assessed(spark, sf_dir).drop("text", "scores").withColumn("fired", F.array_join("fired", ","))


@query("request_tasks", f"""WITH {_ASSESSED}, {_PLANNED} SELECT request_id, request_id || '-T' || lpad(CAST(seq AS VARCHAR), 3, '0') AS task_id, CAST(seq AS INTEGER) AS seq, track, type, CASE WHEN requires_approval AND track IN ('security', 'database') THEN 'critical' ELSE priority END AS priority,
    requires_approval AND track IN ('database', 'deploy', 'security') AS approve, CASE WHEN track = 'documentation' THEN documents END AS documents FROM n""")
def request_tasks(spark, sf_dir):
    return D.decompose(assessed(spark, sf_dir), type_rows()).withColumn("documents", F.array_join("documents", ","))


@query("request_edges", f"""WITH {_ASSESSED}, {_PLANNED}, needs(track, need) AS (VALUES ('documentation', 'analysis'), ('database', 'documentation'), ('backend', 'documentation'), ('backend', 'database'), ('integration', 'backend'), ('frontend', 'backend'), ('tests', 'backend'),
        ('security', 'backend'), ('security', 'tests'), ('performance', 'backend'), ('performance', 'tests'), ('deploy', 'tests'), ('observability', 'backend'), ('validation', 'tests'))
    SELECT x.request_id, x.request_id || '-T' || lpad(CAST(x.seq AS VARCHAR), 3, '0') AS task_id, y.request_id || '-T' || lpad(CAST(y.seq AS VARCHAR), 3, '0') AS depends_on FROM n x JOIN needs ON needs.track = x.track JOIN n y ON y.request_id = x.request_id AND y.track = needs.need""")
def request_edges(spark, sf_dir):
    return D.edges(assessed(spark, sf_dir), type_rows())
