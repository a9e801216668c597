"""Structured Streaming forms of the session, window and de-duplication operators.

Each takes a streaming (or batch) DataFrame of events with a timestamp ``ts``; ``drain`` runs one to its end into a Parquet
folder under the checkpoint directory and reads that back, which is how batch twins are compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorequarry.session import checkpoint_dir

LATE = "2 days"


def stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table as a stream of its files; local timestamps become instants so that watermarks apply."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path if _folder(spark, path) else f"{sf_dir}/{table}.parque[t]")
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def daily_counts(events: DataFrame) -> DataFrame:
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", LATE).groupBy(day.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def sliding_counts(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", "24 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once_per_session(events: DataFrame) -> DataFrame:
    """The first reminder of each client within the watermark."""
    return events.where("event_type = 'error'").withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id"]).select("user_id")


def ledger(events: DataFrame, ttl_ms: int = 45 * 60 * 1000, most: int = 2000) -> DataFrame:
    """(user_id, n, repeats): kept state per client of what was seen within the time to live, oldest out first.

    Entries lie in order of time, so only the old end is looked at; a client that stays away for the time to live loses its state.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen: dict[str, int] = dict(zip(*state.get, strict=True)) if state.exists else {}
        n = repeats = 0
        for frame in frames:
            for kind, at in sorted(zip(frame["event_type"], frame["ms"].astype(int), strict=True), key=lambda x: x[1]):
                while seen and at - seen[first := next(iter(seen))] > ttl_ms:
                    del seen[first]
                repeats += seen.pop(kind, None) is not None
                n += 1
                seen[kind] = at
                if len(seen) > most:
                    del seen[next(iter(seen))]
        state.update((list(seen), list(seen.values())))
        state.setTimeoutTimestamp(max(max(seen.values(), default=0) + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "repeats": [repeats]})

    rows = events.withWatermark("ts", LATE).select("user_id", "event_type", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, repeats long", "kinds array<string>, at array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(spark: SparkSession, df: DataFrame, mode: str = "update") -> DataFrame:
    """Run a streaming DataFrame over what its source holds now; returns the rows of every batch, marked ``__batch``."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")
