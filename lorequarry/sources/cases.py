"""Evaluation sets: files of cases (query, relevant_paths, class, difficulty, note) in YAML or JSON, as a DataFrame.

Files are read by Spark, one a task, and each is a hand-written list of at most ``LARGEST`` bytes. Defined results: an entry
without a query, a file that does not parse or is no list, and one beyond the limit raise an error that names the file;
an entry without paths, or of the class for it, has no answer; repeated entries are kept; an empty folder has no cases.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # JSON files only
    yaml = None

LARGEST = 4_000_000
#: What an entry is without a class or difficulty, and the class of those that have no answer.
CLASS, DIFFICULTY, UNANSWERED = "factual", "easy", "sem_resposta"
CASES = "file string, ordinal int, query string, relevant_paths array<string>, note string, class string, difficulty string"


def _entries(path: str, data: bytes) -> Iterator[tuple]:
    if len(data) > LARGEST:
        raise ValueError(f"{path}: more than {LARGEST} bytes")
    said = data.decode("utf-8-sig")
    try:
        found = json.loads(said) if yaml is None or path.endswith(".json") else yaml.safe_load(said)
    except Exception as e:
        raise ValueError(f"{path}: {e}") from None
    if not isinstance(found or [], list):
        raise ValueError(f"{path}: not a list of cases")
    for k, item in enumerate(found or []):
        if not isinstance(item, dict) or not item.get("query"):
            raise ValueError(f"{path}: entry {k + 1} has no query")
        paths = [str(p) for p in item.get("relevant_paths") or []]
        yield path, k, str(item["query"]), paths, str(item.get("note") or ""), str(item.get("class") or CLASS), str(item.get("difficulty") or DIFFICULTY)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, query, relevant_paths, note, class, difficulty, answerable) of a file or folder of cases."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, content in frame.itertuples(index=False) for r in _entries(p, bytes(content))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CASES.split(", ")])

    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml,json}").load(path).select("path", "content")
    return held.mapInPandas(run, CASES).withColumn("answerable", (F.col("class") != UNANSWERED) & (F.size("relevant_paths") > 0))


def relevant(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """(file, ordinal, doc_id) of relevant paths that are indexed, by documents (doc_id, path)."""
    each = cases.where("answerable").select("file", "ordinal", F.explode("relevant_paths").alias("path")).distinct()
    return each.join(documents.select("doc_id", "path"), "path").select("file", "ordinal", "doc_id").distinct()
