"""Deterministic hashing vectors: no model and no network.

``embed`` hashes with BLAKE2b in Arrow batches. ``Hashing`` is an embedder for search: documents and queries go through the
same steps, hashed with MD5 in Arrow batches, so that SQL can state the same vectors.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.session import cut


def hashed(text: str, dims: int) -> np.ndarray:
    """Unigrams add 1 and 0.5 in two slots, bigrams 0.75; scaled to length one, and never the zero vector."""
    number = lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")
    v, tokens = np.zeros(dims, dtype=np.float32), text.lower().split()
    for h in map(number, tokens):
        v[h % dims] += 1.0
        v[(h >> 16) % dims] += 0.5
    for h in (number(f"{a} {b}") for a, b in zip(tokens, tokens[1:], strict=False)):
        v[h % dims] += 0.75
    if not v.any():
        v[0] = 1.0
    return v / np.linalg.norm(v)


def embed(docs: DataFrame, dims: int) -> DataFrame:
    """(doc_id, hash, vector): each distinct text is embedded once and joined back by its hash."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([hashed(t or "", dims).tolist() for t in texts])

    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "text")
    vectors = rows.groupBy("hash").agg(F.first("text").alias("text")).select("hash", F.pandas_udf(run, "array<float>")("text").alias("vector"))
    return rows.drop("text").join(vectors, "hash").select("doc_id", "hash", "vector")


def slotted(text: bytes, dims: int) -> np.ndarray:
    """Weights of a lower-cased text's slots: of words by the first 60 bits of their MD5, of neighbours likewise."""
    words = text.split()
    if not words:
        return np.eye(1, dims)[0]
    pairs = [b"%b %b" % two for two in zip(words, words[1:], strict=False)]
    seen = Counter(words)
    number = lambda said: np.frombuffer(b"".join([md5(w, usedforsecurity=False).digest() for w in said]), dtype=">u8")[::2].astype(np.uint64) >> np.uint64(4)
    one, n, size = number(seen), np.fromiter(seen.values(), dtype=float, count=len(seen)), np.uint64(dims)
    slots = np.bincount((one % size).astype(np.int64), n, dims) + np.bincount(((one >> np.uint64(16)) % size).astype(np.int64), n * 0.5, dims)
    return slots + 0.75 * np.bincount((number(pairs) % size).astype(np.int64), minlength=dims)


class Hashing:
    """Embeds rows (an id column and ``text``): a word adds 1 and 0.5 in two slots, a pair of neighbours 0.75; of length one."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def documents(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(vec_id, embedding); a null or blank text has its first slot alone, repeated ids add up.

        A row's slots are summed within its row, so what moves is one vector a row; sums of quarters are exact in any order.
        """
        dims, kind = self.dims, docs.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = np.zeros((len(batch), dims))
                for k, text in enumerate(batch.column(1).cast(pa.binary())):
                    slots[k] = slotted(text.as_py(), dims)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, slots.size + 1, dims, dtype=np.int32)), pa.array(slots.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), vectors], ["vec_id", "v"])

        rows = docs.select(F.col(id_col).alias("vec_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, f"vec_id {kind}, v array<double>")
        summed = rows.groupBy("vec_id").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(dims)])
        dense = cut(summed.select("vec_id", F.array(*[f"v{k}" for k in range(dims)]).alias("v")))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        return dense.withColumn("length", length).select("vec_id", F.transform("v", lambda x: x / F.col("length")).alias("embedding"))

    def queries(self, queries: DataFrame, id_col: str = "query_id") -> DataFrame:
        """(query_id, embedding): this model treats queries as documents."""
        return self.documents(queries, id_col).withColumnRenamed("vec_id", "query_id")
