"""Snapshots and incremental maintenance as set operations over keyed DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): created, deleted or modified; equal rows are left out. One full outer join."""
    a, b = old.select(key, F.col(content).alias("__a")), new.select(F.col(key).alias("__k"), F.col(content).alias("__b"))
    change = F.when(F.col(key).isNull(), "created").when(F.col("__k").isNull(), "deleted").when(~F.col("__a").eqNullSafe(F.col("__b")), "modified")
    return a.join(b, F.col(key) == F.col("__k"), "full_outer").select(F.coalesce(key, "__k").alias(key), change.alias("change")).where("change IS NOT NULL")


def merge(table: DataFrame, changes: DataFrame, key: str, deleted: str | None = None) -> DataFrame:
    """``table`` after ``changes`` (one row per key): changed keys are replaced, keys marked deleted go."""
    kept = table.join(changes.select(key), key, "left_anti")
    added = (changes.where(~F.col(deleted)) if deleted else changes).select(*table.columns)
    return kept.unionByName(added)


def rehydrated(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds content and state to chunks (doc_id, start_line, end_line, hash): sliced again from the text and compared by hash."""
    lines = F.slice(F.split("text", "\n"), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    met = chunks.join(docs.select("doc_id", "text"), "doc_id", "left").withColumn("content", F.array_join(lines, "\n"))
    state = F.when(F.col("text").isNull(), "missing").when(F.sha2("content", 256) == F.col("hash"), "ok").otherwise("mismatch")
    return met.select(*chunks.columns, state.alias("state"))


def refresh(derived: DataFrame, recomputed: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Rows derived per key (postings, edges) after some keys changed: only theirs are replaced, also when nothing is left of them."""
    return derived.join(touched.select(key).distinct(), key, "left_anti").unionByName(recomputed.select(*derived.columns))


def change_token(state: DataFrame, configuration: str) -> DataFrame:
    """(token): a digest of the one row of ``state`` (run, generation) and of the configuration."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return state.select(F.sha2(F.concat_ws(":", part("run"), part("generation"), F.lit(configuration)), 256).alias("token"))
