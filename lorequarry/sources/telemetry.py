"""A telemetry log: one JSON line per call, in a folder per day, with bounded files, retention, and statistics of tools.

Lines hold counts and codes, never a query, an argument or the text of an answer or an error. A batch is written as folders
``day=.../batch=...`` that are replaced as a whole, so a batch that is written again after a lost executor or a restart of
the stream changes nothing. Files are cut at a number of lines; what is older than the retention goes by whole days.

Defined results: rows without a time or tool are no calls; a null outcome is unknown and counts in no error rate; a null text
has no characters; lines that do not parse are skipped; an empty batch or folder gives no rows.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lorequarry.functions.text import token_count

VERSION = 2
FIELDS = "v int, ts timestamp, tool string, ms double, project string, ok boolean, err_code string, degraded boolean, resp_chars long, resp_tokens long"
#: Lines of a file, some 5 MB of them, and days that are kept.
LINES, RETAIN_DAYS = 20_000, 30


def entries(calls: DataFrame, codes: tuple[str, ...] = ()) -> DataFrame:
    """Lines of calls (ts, tool, ms, project, ok, error, degraded, text): an error keeps its code only if it is a listed one."""
    error = F.when(F.col("ok"), F.lit(None)).when(F.col("error").isin(*codes) if codes else F.lit(False), F.col("error")).otherwise("unknown")
    text = F.coalesce("text", F.lit(""))
    rows = calls.where("ts IS NOT NULL AND tool IS NOT NULL").select(
        F.lit(VERSION).alias("v"), "ts", "tool", "ms", "project", "ok", F.when(F.col("ok").isNotNull(), error).alias("err_code"), F.when(F.col("degraded"), True).alias("degraded"),
        F.length(text).cast("long").alias("resp_chars"), token_count(text).cast("long").alias("resp_tokens"),
    )
    return rows


def append(lines: DataFrame, path: str, batch: int | str) -> None:
    """Write the lines of a batch; the same batch again replaces what it wrote."""
    days = lines.withColumns({"day": F.to_date("ts"), "batch": F.lit(str(batch))})
    out = days.write.partitionBy("day", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.option("maxRecordsPerFile", LINES).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def sink(calls: DataFrame, path: str, checkpoint: str, codes: tuple[str, ...] = ()) -> DataStreamWriter:
    """The writer of a stream of calls; each micro-batch is a batch of the log."""
    return calls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, k: append(entries(rows, codes), path, k))


def read(spark: SparkSession, path: str, since: date | None = None) -> DataFrame:
    """Lines of the log, from a day on if asked; only the folders of those days are listed as input."""
    try:
        rows = spark.read.schema(f"{FIELDS}, day date, batch string").json(path)
    except AnalysisException:  # nothing has been written yet
        rows = spark.createDataFrame([], f"{FIELDS}, day date, batch string")
    rows = rows.where(F.col("day") >= F.lit(since)) if since else rows
    return rows.where("ts IS NOT NULL AND tool IS NOT NULL").drop("batch")


def expire(spark: SparkSession, path: str, today: date, days: int = RETAIN_DAYS) -> list[str]:
    """Remove the folders of days beyond the retention; says which. No days given to keep means that all are kept."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if days <= 0 or not store.exists(root):
        return []
    oldest, gone = (today - timedelta(days=days)).isoformat(), []
    for held in store.listStatus(root):  # a folder a day
        name = held.getPath().getName()
        if held.isDirectory() and name.startswith("day=") and name[4:] < oldest and store.delete(held.getPath(), True):
            gone.append(name[4:])
    return sorted(gone)


def tool_statistics(lines: DataFrame, by: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Calls, median and 95th percentile of the time, and the share of errors among outcomes that are known."""
    known, wrong = F.count_if(F.col("ok").isNotNull()), F.count_if(~F.col("ok"))
    quantile = lambda q: F.percentile(F.col("ms"), q)
    timed = lines.where("ms IS NOT NULL")
    return timed.groupBy(*by).agg(F.count("*").alias("calls"), quantile(0.5).alias("p50"), quantile(0.95).alias("p95"), known.alias("known"), wrong.alias("errors"), rate(wrong, known).alias("error_rate"))


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)
