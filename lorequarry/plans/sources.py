"""Source and sink queries: each writes what it derives from a table in the shared folder and reads it back."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from lorequarry.functions import ids as I
from lorequarry.functions import vector as V
from lorequarry.plans.registry import query
from lorequarry.session import checkpoint_dir, read_table
from lorequarry.sources import files, telemetry, vectors


def folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@query("json_log_roundtrip", "SELECT event_type AS tool, count(*) AS calls, round(sum(value), 2) AS ms FROM events GROUP BY event_type")
def json_log_roundtrip(spark, sf_dir):
    path = folder(spark)
    good = read_table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_type").alias("tool"), F.col("value").alias("ms"))).alias("value"))
    good.unionByName(good.limit(5).select(F.lit("{broken").alias("value"))).write.text(path)
    return files.json_log(spark, path, "tool string, ms double").groupBy("tool").agg(F.count("*").alias("calls"), F.round(F.sum("ms"), 2).alias("ms"))


@query("sharded_json_roundtrip", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents")
def sharded_json_roundtrip(spark, sf_dir):
    path = folder(spark)
    key = I.digest(F.col("doc_id"))
    files.write_sharded_json(read_table(spark, sf_dir, "documents").select(key.alias("id"), "doc_id", I.shard_of(key, 16).alias("shard")), path)
    return spark.read.schema("id string, doc_id long, shard string").json(path).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query("file_tree_scan", "SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(url)) AS BIGINT) AS chars FROM pages")
def file_tree_scan(spark, sf_dir):
    path = folder(spark)
    read_table(spark, sf_dir, "pages").select("url").write.text(path)
    lines = files.tree(spark, path, deny=r"/_SUCCESS$|\.crc$").where("state = 'text'").select(F.explode(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("line"))
    return lines.agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("vector_store_roundtrip", "SELECT vec_id, CAST(CAST('0x' || left(md5(CAST(vec_id AS VARCHAR)), 2) AS INTEGER) % 16 AS INTEGER) AS shard, true AS same FROM embeddings")
def vector_store_roundtrip(spark, sf_dir):
    """Quantised vectors through sixteen sorted shards and back, byte for byte."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.md5(F.col("vec_id").cast("string").cast("binary")).alias("id"), V.quantized(F.col("embedding"), 32).alias("q"))
    held = rows.select("vec_id", "id", F.col("q.scale").cast("float").alias("scale"), F.col("q.offset").cast("float").alias("offset"), F.col("q.codes").cast("array<int>").alias("codes"))
    path = f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex[:12]}"
    vectors.write_store(held.drop("vec_id"), path, "hashing-64", 32)
    back, _ = vectors.read_store(spark, path, "hashing-64", 32)
    met = held.join(back.select("id", F.col("codes").alias("c"), F.col("scale").alias("s"), F.col("offset").alias("o")), "id", "left")
    same = F.col("codes").eqNullSafe(F.col("c")) & F.col("scale").eqNullSafe(F.col("s")) & F.col("offset").eqNullSafe(F.col("o"))
    return met.select("vec_id", (F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % 16).alias("shard"), same.alias("same"))


_CALLS = """c AS (SELECT event_type AS tool, CAST(ts AS DATE) AS day, value AS ms, CASE WHEN user_id % 5 <> 0 THEN event_type <> 'error' END AS ok FROM events WHERE ts >= TIMESTAMP '2024-01-05')"""


@query("telemetry_log", f"""WITH {_CALLS} SELECT day, tool, count(*) AS calls, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, count(ok) AS known, count(*) FILTER (NOT ok) AS errors,
    round(count(*) FILTER (NOT ok) / nullif(count(ok), 0), 6) AS error_rate FROM c WHERE ms IS NOT NULL GROUP BY day, tool""")
def telemetry_log(spark, sf_dir):
    """Events as calls through the log: written in two batches, the second of them twice, days before the fifth of January expired, and read back."""
    path = folder(spark)
    ok = F.when(F.col("user_id") % 5 != 0, F.col("event_type") != "error")
    calls = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("tool"), F.col("value").alias("ms"), F.col("user_id").cast("string").alias("project"), ok.alias("ok"), F.lit("failed").alias("error"),
        F.lit(False).alias("degraded"), F.col("props").alias("text"),
    )
    for batch in (0, 1, 1):
        telemetry.append(telemetry.entries(calls.where(F.col("event_id") % 2 == batch), ("failed",)), path, batch)
    telemetry.expire(spark, path, date(2024, 1, 8), 3)
    rows = telemetry.tool_statistics(telemetry.read(spark, path), ("day", "tool"))
    return rows.select("day", "tool", "calls", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "known", "errors", F.round("error_rate", 6).alias("error_rate"))
