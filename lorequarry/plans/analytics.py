"""Aggregations, telemetry, evaluation and panel queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorequarry.functions import stats
from lorequarry.plans.registry import both, query
from lorequarry.session import read_table

both("doc_by_lang", "SELECT lang, count(*) AS n FROM {documents} GROUP BY lang")
both("count_by_type", "SELECT p_type AS type, count(*) AS n FROM {part} GROUP BY p_type ORDER BY n DESC, type")
both("pending_embeddings", "SELECT count(*) AS total, count(DISTINCT e.vec_id) AS embedded, count(*) - count(DISTINCT e.vec_id) AS pending FROM {documents} d LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id")
both("vectors_per_model", "SELECT label AS model, count(*) AS n FROM {embeddings} GROUP BY label")
both("in_degree", "SELECT l_partkey AS node, count(*) AS degree FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY l_partkey")
both("degree_union", """SELECT node, count(*) AS degree FROM (SELECT o_orderkey AS rid, o_custkey AS node FROM {orders} UNION SELECT o_orderkey, o_orderkey % 100 FROM {orders}) e GROUP BY node""")
both("homonyms", "SELECT lower(p_name) AS name, count(*) AS n FROM {part} GROUP BY lower(p_name)")
both("pair_weight", "SELECT c_nationkey AS src, s_nationkey AS dst, round(sum(l_quantity * (1 - l_discount)), 2) AS weight FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {supplier} ON s_suppkey = l_suppkey GROUP BY c_nationkey, s_nationkey")
both("module_rollup", """WITH m AS (SELECT source AS top, concat(source, '/', lang) AS sub, n_chars FROM {documents}), t AS (SELECT top, count(*) AS n FROM m GROUP BY top), a AS (SELECT count(*) AS total FROM m)
    SELECT CASE WHEN t.n > 0.07 * a.total THEN m.sub ELSE m.top END AS module, count(*) AS docs, CAST(sum(m.n_chars) AS BIGINT) AS chars FROM m JOIN t ON t.top = m.top CROSS JOIN a GROUP BY CASE WHEN t.n > 0.07 * a.total THEN m.sub ELSE m.top END""")
both("convention_having", "SELECT source, lang, count(*) AS n, round(least(0.6 + 0.1 * count(*), 0.95), 2) AS confidence FROM {documents} GROUP BY source, lang HAVING count(*) >= 3")
both("dominant_key", "SELECT source, max_by(lang, w) AS dominant FROM (SELECT source, lang, count(*) * 1000 + ascii(substr(lang, 1, 1)) AS w FROM {documents} GROUP BY source, lang) t GROUP BY source")
both("concepts_two_levels", """WITH c AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS cls FROM {lineitem}), few AS (SELECT cls FROM c GROUP BY cls HAVING count(*) <= 40)
    SELECT doc, count(*) AS classes, min(c.cls) AS first_class FROM c JOIN few ON few.cls = c.cls GROUP BY doc HAVING count(*) >= 2""")
both("size_by_category", "SELECT lang AS category, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, max(n_chars) AS largest, max_by(doc_id, n_chars * 1000000 + doc_id) AS largest_doc, count(CASE WHEN n_chars > 20000 THEN 1 END) AS oversized FROM {documents} GROUP BY lang")
both("size_projection", "SELECT count(*) AS chunks, count(*) * (180 + 64) + count(*) * 60 AS projected, count(*) * (180 + 64) + count(*) * 60 > 1000000 AS refused FROM {documents}")
both("manifest_counts", "SELECT (SELECT count(*) FROM {documents}) AS documents, (SELECT count(*) FROM {embeddings}) AS vectors, (SELECT count(*) FROM {conversations}) AS turns, (SELECT count(*) FROM {pages}) AS pages")
both("baseline_tokens", "SELECT lang, coalesce(CAST(sum(n_chars) AS BIGINT), 0) AS baseline FROM {documents} GROUP BY lang")
both("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY o_orderstatus")
both("calls_by_tool", "SELECT event_type AS tool, count(*) AS calls, round(sum(value), 2) AS tokens, count(CASE WHEN value < 1 THEN 1 END) AS degraded, max_by(user_id, event_id) AS last_client FROM {events} GROUP BY event_type")
both("tool_p50_p95", "SELECT event_type AS tool, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 4) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 4) AS p95, count(*) AS n FROM {events} GROUP BY event_type")
both("quartiles", "SELECT lang, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY n_chars), 4) AS q1, round(median(n_chars), 4) AS q2, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY n_chars), 4) AS q3 FROM {documents} GROUP BY lang")
both("nearest_rank", "SELECT event_type, round(value, 4) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM {events}) t WHERE rn = CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT) + 1")
both("ab_summary", "SELECT CAST(user_id % 3 AS INT) AS arm, count(*) AS calls, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0E0 ELSE 0.0E0 END), 4) AS hit_rate, round(median(value), 4) AS median_value FROM {events} GROUP BY user_id % 3")
both("ab_rotation", "SELECT user_id AS task, event_id % 3 AS rep, (user_id + event_id % 3) % 3 AS first_arm, count(*) AS n FROM {events} GROUP BY user_id, event_id % 3")
both("documents_per_origin", "SELECT CASE WHEN source LIKE 'src1%' THEN '@base/src1' ELSE 'project' END AS origin, count(*) AS n FROM {documents} GROUP BY CASE WHEN source LIKE 'src1%' THEN '@base/src1' ELSE 'project' END")
both("drop_reasons", "SELECT lower(substr(p_type, 1, CASE WHEN instr(p_type, ' ') = 0 THEN CAST(length(p_type) AS INT) ELSE CAST(instr(p_type, ' ') AS INT) - 1 END)) AS reason, count(*) AS n FROM {part} GROUP BY 1")
both("gold_funnel", """SELECT step, count(*) AS n FROM (SELECT CASE WHEN length(text) < 60 THEN '1 short' WHEN lang <> 'en' THEN '2 language' WHEN text LIKE '%|%' THEN '3 table' WHEN n_chars > 8000 THEN '4 long' ELSE '5 kept' END AS step FROM {documents}) t GROUP BY step""")
both("worst_severity", "SELECT user_id, max(CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END) AS worst FROM {events} GROUP BY user_id")
both("report_rollup", "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
both("daily_savings_zero_fill", """WITH RECURSIVE days AS (SELECT CAST(min(ts) AS DATE) AS d, 0 AS k FROM {events} UNION ALL SELECT CAST(d + INTERVAL 1 DAY AS DATE), k + 1 FROM days WHERE k < 13)
    SELECT d AS day, coalesce(round(sum(e.value), 2), 0) AS saved, count(e.event_id) AS n FROM days LEFT JOIN (SELECT event_id, CAST(ts AS DATE) AS day, value FROM {events} WHERE event_type = 'signup' AND value > 5) e ON e.day = d GROUP BY d""")
both("usage_dedup_max", "SELECT conv_id, CAST(sum(m) AS BIGINT) AS tokens FROM (SELECT conv_id, CAST(floor(turn / 2) AS INT) AS message, max(length(text)) AS m FROM {conversations} GROUP BY conv_id, CAST(floor(turn / 2) AS INT)) t GROUP BY conv_id")
both("turn_grouping", "SELECT conv_id, max(island) AS turns FROM (SELECT conv_id, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT conv_id, turn, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM {conversations}) a) b GROUP BY conv_id".replace("max(island)", "CAST(max(island) AS BIGINT)"))
both("adoption_sessions", """SELECT count(*) AS sessions, count(CASE WHEN started > 0 THEN 1 END) AS with_start, count(CASE WHEN calls > 0 THEN 1 END) AS with_calls, count(CASE WHEN calls > 0 AND started = 0 THEN 1 END) AS calls_without_start
    FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(CASE WHEN event_type = 'signup' THEN 1 END) AS started, count(CASE WHEN event_type = 'click' THEN 1 END) AS calls FROM {events} GROUP BY user_id, CAST(ts AS DATE)) t""")
both("reminder_conversion", """SELECT count(*) AS reminded, count(CASE WHEN last_call > first_reminder THEN 1 END) AS converted FROM (SELECT user_id, min(CASE WHEN event_type = 'error' THEN ts END) AS first_reminder, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_call FROM {events} GROUP BY user_id) t WHERE first_reminder IS NOT NULL""")
both("rate_limit_hits", """SELECT user_id, count(*) AS refused FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW) AS recent FROM {events}) t WHERE recent > 3 GROUP BY user_id""")
both("agent_eval", "SELECT conv_id, count(CASE WHEN rn <= 3 AND text LIKE '%tion%' THEN 1 END) > 0 AS mentions, count(CASE WHEN text LIKE '%<|%' THEN 1 END) = 0 AS clean FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM {conversations} WHERE role = 'assistant') t GROUP BY conv_id")
both("prompt_footprint", "SELECT role, CAST(sum(CAST(floor((length(text) + 3) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM {conversations} GROUP BY role")
both("sessions_by_user", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 15 MINUTES THEN 0 ELSE 1 END AS fresh FROM {events}) t WHERE fresh = 1 GROUP BY user_id")
both("token_trial", "SELECT l.doc_id, d.n_chars AS whole, least(d.n_chars, 3000) AS assembled, round(least(d.n_chars, 3000) / CAST(nullif(d.n_chars, 0) AS DOUBLE), 4) AS ratio FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id WHERE l.quality = 1")
both("auto_cases", """SELECT p_partkey, p_name FROM {part} JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey) d ON d.l_partkey = p_partkey ORDER BY d.n DESC, p_partkey LIMIT 20""")
both("conclusive_flag", f"""SELECT lang, n, hits, round(2 * {stats.Z95} * sqrt(p * (1 - p) / n), 4) <= 0.2 AS conclusive FROM (SELECT lang, count(*) AS n, count(CASE WHEN n_chars > 1000 THEN 1 END) AS hits, avg(CASE WHEN n_chars > 1000 THEN 1.0E0 ELSE 0.0E0 END) AS p FROM {{documents}} GROUP BY lang) t""")

# panel
both("duration_trend", """SELECT user_id, CASE WHEN n < 6 THEN 'few' WHEN newest > 1.5 * rest THEN 'slower' ELSE 'steady' END AS trend FROM (SELECT user_id, count(*) AS n, median(CASE WHEN rn <= 3 THEN value END) AS newest, median(CASE WHEN rn > 3 THEN value END) AS rest
    FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) a GROUP BY user_id) b""")
both("consecutive_failures", """SELECT user_id, CAST(coalesce(min(CASE WHEN event_type <> 'view' THEN rn END) - 1, max(rn)) AS INT) AS streak FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) a GROUP BY user_id""")
both("health_checks", """SELECT check_name, level FROM (SELECT 'errors' AS check_name, CASE WHEN count(CASE WHEN event_type = 'error' THEN 1 END) > 0.3 * count(*) THEN 2 ELSE 0 END AS level FROM {events}
    UNION ALL SELECT 'labels', CASE WHEN count(*) = 0 THEN 2 ELSE 0 END FROM {labels} UNION ALL SELECT 'vectors', CASE WHEN count(*) < 10000 THEN 1 ELSE 0 END FROM {embeddings}) t""")
both("activity_totals", "SELECT count(*) AS events, count(DISTINCT user_id) AS sessions, count(DISTINCT event_type) AS kinds, count(CASE WHEN user_id IS NULL THEN 1 END) AS unidentified FROM {events}")
both("session_groups", "SELECT user_id, CAST(ts AS DATE) AS day, count(CASE WHEN event_type = 'signup' THEN 1 END) AS starts, count(CASE WHEN event_type = 'click' THEN 1 END) AS calls, round(sum(value), 4) AS tokens FROM {events} GROUP BY user_id, CAST(ts AS DATE)")
both("merge_new_events", "SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (PARTITION BY event_id ORDER BY v DESC) AS rn, ts FROM (SELECT event_id, value, ts, 1 AS v FROM {events} UNION ALL SELECT event_id, value + 1, ts, 2 FROM {events} WHERE event_id % 5 = 0) u) t WHERE rn = 1 ORDER BY ts DESC, event_id DESC LIMIT 500")
both("live_projects", "SELECT DISTINCT user_id FROM {events} WHERE ts >= (SELECT max(ts) FROM {events}) - INTERVAL 6 HOURS")
both("event_filter", "SELECT event_id FROM {events} WHERE event_type IN ('click', 'error') AND user_id % 4 = 1")
both("project_state", "SELECT c_custkey, CASE WHEN n = 0 THEN 'empty' WHEN failed > 5 THEN 'failed' WHEN open > 3 THEN 'running' WHEN n > 12 THEN 'busy' ELSE 'ready' END AS state FROM (SELECT c_custkey, count(o_orderkey) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS failed, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey) t")
both("active_job", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS rn FROM {orders}) t WHERE rn = 1")
both("savings_ratio", "SELECT user_id, round(greatest(0.0, (base - used) / nullif(base, 0)), 4) AS ratio, round(greatest(0.0, base - used), 4) AS saved FROM (SELECT user_id, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS base, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS used FROM {events} GROUP BY user_id) t")
both("multi_key_sort", """SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY last_use DESC NULLS LAST, c_custkey) AS INT) AS place FROM {customer} LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_use FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey""")
both("first_last_change", "SELECT user_id, round((last_value - first_value_) / nullif(first_value_, 0) * 100, 2) AS change FROM (SELECT user_id, min_by(value, event_id) AS first_value_, max_by(value, event_id) AS last_value FROM {events} GROUP BY user_id) t")
both("goals_met", "SELECT count(CASE WHEN n > 100 THEN 1 END) AS met, count(*) AS total FROM (SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type) t")
both("missing_embeddings", "SELECT greatest(d - v, 0) AS missing FROM (SELECT (SELECT count(*) FROM {documents}) AS d, (SELECT count(*) FROM {embeddings}) AS v) t")
both("freshness_verdict", "SELECT source, CASE WHEN count(*) = 0 THEN 'unknown' WHEN count(CASE WHEN e.vec_id IS NULL THEN 1 END) > 0 THEN 'stale' ELSE 'fresh' END AS verdict FROM {documents} LEFT JOIN {embeddings} e ON e.vec_id = doc_id GROUP BY source")
both("undated_rows", "SELECT count(*) AS total, count(ts) AS dated, count(DISTINCT CAST(ts AS DATE)) AS days FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts FROM {events}) t")
both("sliding_day_counts", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY CAST(ts AS DATE) ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM {events} GROUP BY CAST(ts AS DATE)")
both("contract_search", "SELECT c.conv_id, c.turn, p.p_brand, p.p_retailprice FROM {conversations} c JOIN {part} p ON p.p_partkey = c.conv_id * 3 + c.turn WHERE p.p_retailprice > 1000")
both("external_penalty", "SELECT doc_id, round(CASE WHEN source = 'src0' THEN n_chars * 1.0E0 ELSE n_chars * 0.85E0 END, 2) AS score FROM {documents} ORDER BY score DESC, doc_id LIMIT 50")


@query("gap_attribution", """WITH g AS (SELECT user_id, event_type, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS gap FROM events)
    SELECT user_id, CAST(coalesce(sum(gap) FILTER (gap < 900 AND event_type = 'view'), 0) AS BIGINT) AS human, CAST(coalesce(sum(gap) FILTER (gap < 900 AND event_type <> 'view'), 0) AS BIGINT) AS tool, count(*) FILTER (gap >= 900) AS idle FROM g GROUP BY user_id""")
def gap_attribution(spark, sf_dir):
    """Seconds between a client's consecutive events, dealt by what ended them; a quarter of an hour counts as idle."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    gap = s - F.lag(s).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_type", gap.alias("gap"))
    spent = lambda which: F.coalesce(F.sum(F.when((F.col("gap") < 900) & which, F.col("gap"))), F.lit(0))
    view = F.col("event_type") == "view"
    return rows.groupBy("user_id").agg(spent(view).alias("human"), spent(~view).alias("tool"), F.count_if(F.col("gap") >= 900).alias("idle"))


@query("run_duration", "SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate >= o_orderdate THEN CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) END AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def run_duration(spark, sf_dir):
    """Days from order to shipping; a negative duration is unknown."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    met = lines.join(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("l_orderkey", "l_linenumber", F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.datediff("l_shipdate", "o_orderdate")).alias("days"))


@query("rate_limit_range", """SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events""")
def rate_limit_range(spark, sf_dir):
    """Calls of the last hour per client, as a range frame."""
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return read_table(spark, sf_dir, "events").withColumn("s", s).select("event_id", F.count("*").over(w).alias("recent"))


@query("usage_metrics", """SELECT user_id % 2 = 0 AS with_tool, round(median(n), 4) AS median_calls, round(median(v), 4) AS median_value, CAST(sum(n) AS BIGINT) AS calls FROM (SELECT user_id, count(*) AS n, sum(value) AS v FROM events GROUP BY user_id) t GROUP BY user_id % 2 = 0""")
def usage_metrics(spark, sf_dir):
    per = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return per.groupBy((F.col("user_id") % 2 == 0).alias("with_tool")).agg(F.round(F.median("n"), 4).alias("median_calls"), F.round(F.median("v"), 4).alias("median_value"), F.sum("n").alias("calls"))


@query("bootstrap_median")
def bootstrap_median(spark, sf_dir):
    """95 % interval of the median by bootstrap with a fixed seed: equal data give equal intervals."""
    from lorequarry.operators.evaluation import bootstrap_interval

    per = read_table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("value"))
    return bootstrap_interval(per, "event_type", "value")
