"""Incremental maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.operators import chunking, incremental, knowledge, security
from lorequarry.plans.registry import both, query
from lorequarry.session import read_table

both("base_rows_excluded", "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {documents} b WHERE b.doc_id < 3 AND b.source = d.source)")


@query("change_token", "SELECT sha256((SELECT CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) FROM events WHERE event_type <> 'view') || ':' || (SELECT CAST(count(*) AS VARCHAR) FROM events) || ':' || 'bm25=1.2,0.75') AS token")
def change_token(spark, sf_dir):
    """A digest of the last effective run, the generation and the configuration: it changes when any of them does."""
    events = read_table(spark, sf_dir, "events")
    last = events.where("event_type <> 'view'").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("run"))
    return incremental.change_token(last.join(events.agg(F.count("*").alias("generation"))), "bm25=1.2,0.75")


@query("graph_incremental", r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 31 = 5 AND doc_id < 1400 THEN text || ' ' || (SELECT text FROM documents WHERE doc_id = 7) ELSE text END), '[\p{L}\p{N}]+') AS w FROM documents),
    e AS (SELECT 'd' || doc_id AS id, w[1] AS name, doc_id FROM d WHERE len(w) > 0 QUALIFY count(*) OVER (PARTITION BY w[1]) <= 4), m AS (SELECT DISTINCT doc_id, unnest(w) AS name FROM d)
    SELECT 'd' || m.doc_id AS src, count(*) AS edges, sha256(string_agg(e.id, ',' ORDER BY e.doc_id)) AS hash FROM m JOIN e ON e.name = m.name AND e.doc_id <> m.doc_id GROUP BY m.doc_id""")
def graph_incremental(spark, sf_dir):
    """Some documents gain another's text: only edges born in them are derived again, and the graph equals a full build."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    extract = knowledge.titles_and_words(T.words)
    graph = knowledge.build(docs, extract)
    touched = docs.where("doc_id % 31 = 5 AND doc_id < 1400").select("doc_id")
    more = docs.where("doc_id = 7").select(F.col("text").alias("more"))
    now = docs.join(F.broadcast(more), F.col("doc_id").isNotNull(), "left").select("doc_id", F.when((F.col("doc_id") % 31 == 5) & (F.col("doc_id") < 1400), F.concat_ws(" ", "text", "more")).otherwise(F.col("text")).alias("text"))
    after = knowledge.update(graph, now, touched, extract)
    hash_ = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.substring("dst", 2, 20).cast("long"))), lambda i: F.concat(F.lit("d"), i)), ","), 256)
    return after.edges.groupBy("src").agg(F.count("*").alias("edges"), hash_.alias("hash"))


@query("snapshot_changes", """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'created' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0) a
    FULL OUTER JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 6 <> 0) b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def snapshot_changes(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.where("doc_id % 6 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))
    return incremental.diff(old, new, "doc_id", "h")


@query("upsert_documents", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, n_chars + 1 FROM documents WHERE doc_id % 8 = 0")
def upsert_documents(spark, sf_dir):
    """Every fourth document changes, and every other of those is deleted."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    changes = docs.where("doc_id % 4 = 0").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), (F.col("doc_id") % 8 != 0).alias("gone"))
    return incremental.merge(docs, changes, "doc_id", "gone")


@query("rehydrate")
def rehydrate(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = chunking.line_chunks(docs, 2000).select("doc_id", "ordinal", "start_line", "end_line", F.sha2("content", 256).alias("hash"))
    now = docs.where("doc_id % 9 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("edited "), "text")).otherwise(F.col("text")))
    return incremental.rehydrated(chunks, now).groupBy("state").agg(F.count("*").alias("n"))


@query("index_maintenance", r"""SELECT doc_id, count(DISTINCT w) AS terms FROM (SELECT doc_id, unnest(regexp_extract_all(lower(CASE WHEN doc_id % 6 = 0 THEN 'new words ' || text ELSE text END), '[\p{L}\p{N}]+')) AS w FROM documents WHERE doc_id % 10 <> 9) t GROUP BY doc_id""")
def index_maintenance(spark, sf_dir):
    """Postings after every sixth document changed and every tenth went: only touched documents are tokenised again."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    postings = lambda d: d.select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    edited = docs.where("doc_id % 6 = 0").withColumn("text", F.concat(F.lit("new words "), "text"))
    gone = docs.where("doc_id % 10 = 9").select("doc_id")
    now = incremental.refresh(postings(docs), postings(edited.join(gone, "doc_id", "left_anti")), edited.select("doc_id").unionByName(gone), "doc_id")
    return now.groupBy("doc_id").agg(F.count("*").alias("terms"))


@query("graph_refresh", "SELECT o_custkey AS src, count(*) AS edges, round(sum(CASE WHEN o_custkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END), 2) AS weight FROM orders GROUP BY o_custkey")
def graph_refresh(spark, sf_dir):
    """Outgoing edges of touched customers are rewritten, all others stay."""
    edges = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("w"))
    touched = edges.where("src % 5 = 0")
    now = incremental.refresh(edges, touched.withColumn("w", F.col("w") * 2), touched, "src")
    return now.groupBy("src").agg(F.count("*").alias("edges"), F.round(F.sum("w"), 2).alias("weight"))


@query("board_roundtrip", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def board_roundtrip(spark, sf_dir):
    """A board as JSON rows and back; what was running elsewhere is pending here."""
    rows = read_table(spark, sf_dir, "orders").select(F.to_json(F.struct("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("none"))).alias("j"))
    back = rows.select(F.from_json("j", "o_orderkey long, status string").alias("r")).select("r.*")
    return back.groupBy(F.when(F.col("status") == "P", "pending").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


@query("export_rescan", "SELECT CAST(count(*) AS BIGINT) AS exported, CAST(0 AS BIGINT) AS blocked FROM pages")
def export_rescan(spark, sf_dir):
    """Rows go out only after another scan; pages hold no secrets of the content rules."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    bad = security.verdicts(security.findings(pages), "strict").where("verdict = 'block'").select("doc_id", F.lit(1).alias("bad"))
    return pages.select("doc_id").join(bad, "doc_id", "left").agg(F.count_if(F.col("bad").isNull()).alias("exported"), F.count("bad").alias("blocked"))
