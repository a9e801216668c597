"""The corpus pipeline: five stages over documents, each a training-data operator.

Quality classifier (documents that it rejects go), exact deduplication (of equal texts the largest id stays), SimHash
near-deduplication (five-word shingles, similarity 0.8; one document of each group stays), secret scan (secrets are
replaced in the text), packing (pieces of documents in windows of 2048 tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorequarry.llm import exact_dedup, packing, quality, secret_scan, simhash
from lorequarry.session import cut, read_table

#: (name, function of the session, the rows its predecessor kept, and the tables' folder)
STAGES = [
    ("quality_classifier", lambda spark, docs, sf_dir: quality.keep(docs, read_table(spark, sf_dir, "labels"))),
    ("exact_dedup", lambda spark, docs, sf_dir: exact_dedup.dedup(docs)),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: simhash.near_dedup(docs)),
    ("secret_scan", lambda spark, docs, sf_dir: secret_scan.redact(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack(docs)),
]

#: Language-model scores, fingerprints and the packing programme have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
