"""Streaming queries, run over the whole table with one availableNow trigger, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorequarry.plans.registry import query
from lorequarry.session import read_table
from lorequarry.streaming import events as E
from lorequarry.streaming import tail as L


@query("stream_daily_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    rows = E.drain(spark, E.daily_counts(E.stream(spark, sf_dir)))
    return rows.groupBy("day", "event_type").agg(F.max_by("n", "__batch").alias("n"))


@query("session_windows", """SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > ts - INTERVAL 15 MINUTES THEN 0 ELSE 1 END AS fresh FROM events) t WHERE fresh = 1 GROUP BY user_id""")
def session_windows(spark, sf_dir):
    """The batch form of the streaming operator: the same plan without a trigger."""
    events = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(events).groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("sliding_windows", """SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOURS, ts) - k * INTERVAL 6 HOURS FOR k IN [0, 1, 2, 3]]) AS w FROM events) t GROUP BY 1""")
def sliding_windows(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sliding_counts(events).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("stream_once_per_session", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error'")
def stream_once_per_session(spark, sf_dir):
    return E.drain(spark, E.once_per_session(E.stream(spark, sf_dir)), "append").select("user_id").distinct()


@query("stream_session_ledger")
def stream_session_ledger(spark, sf_dir):
    return E.drain(spark, E.ledger(E.stream(spark, sf_dir)), "append").groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("repeats").alias("repeats"))


_BURSTS = """m AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ms, epoch_us(max(ts) OVER ()) // 1000 AS top FROM events),
    s AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY key ORDER BY ms) <= 21600000 THEN 0 ELSE 1 END AS fresh FROM m),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ms ROWS UNBOUNDED PRECEDING) AS burst FROM s),
    b AS (SELECT key, min(ms) AS first, max(ms) AS last, count(*) AS n, max(top) AS top FROM g GROUP BY key, burst)"""


def _changes(events):
    """Events as changes of the thing that they name, by user."""
    return events.select(F.col("user_id").cast("string").alias("key"), "ts", F.concat_ws("/", "event_type", "props").alias("path"))


@query("debounced_changes", f"WITH {_BURSTS} SELECT key, first, last, n FROM b")
def debounced_changes(spark, sf_dir):
    """Bursts of a user's events with six quiet hours after them, over the finished table."""
    return L.debounced(_changes(read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))), 21_600_000)


@query("stream_debounce", f"WITH {_BURSTS} SELECT key, first, last, n FROM b WHERE last + 21600000 < top")
def stream_debounce(spark, sf_dir):
    """The same from a stream: event-time timers hand on each burst whose quiet period the watermark has passed."""
    return E.drain(spark, L.debounce(_changes(E.stream(spark, sf_dir)), 21_600_000, most=1 << 30), "append").select("key", "first", "last", "n")
