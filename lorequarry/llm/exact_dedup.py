"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of bytes. Each chunk hashes on its own, and hashes combine by length-shifted arithmetic,
``h(xy) = h(x) * B**len(y) + h(y) mod (2**61 - 1)``, so a huge text never needs one long sequential pass. Texts whose
fingerprint and length agree form a group; the chunks of groups of two or more are then compared byte by byte as they
stream through an aggregation (smallest chunk equal to largest chunk at every position). A group that fails the comparison
is split by SHA-256, so results do not hang on the fingerprint.

Defined results: a null text counts as empty; texts are equal when they are identical after lower-casing A-Z only; of
equal texts the row with the largest id stays, a null id counts as the smallest, and among rows that repeat the largest
id exactly one stays; an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import BROADCAST_ROWS, ascii_lower, fresh, texts, without
from lorequarry.session import cut

PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51
CHUNK = 8192
#: Bytes of chunk rows that a task holds before it hands them on.
FLUSH = 4 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**(n-1) .. BASE**0`` modulo the prime, split in a high and a low half that sum without overflow."""
    x, out = 1, []
    for _ in range(n):
        out.append(x)
        x = x * BASE % PRIME
    p = np.array(out[::-1], dtype=np.uint64)
    return (p >> np.uint64(31)).astype(np.int64), (p & np.uint64((1 << 31) - 1)).astype(np.int64)


_HIGH, _LOW = _powers(CHUNK)


def chunk_hash(data: np.ndarray, modulus: int = PRIME) -> int:
    """Polynomial hash of at most CHUNK bytes."""
    n, wide = len(data), data.astype(np.int64)
    return ((int(wide @ _HIGH[CHUNK - n :]) << 31) + int(wide @ _LOW[CHUNK - n :])) % PRIME % modulus


def combine(left: int, right: int, right_len: int) -> int:
    """Hash of a concatenation from the hashes of its parts."""
    return (left * pow(BASE, right_len, PRIME) + right) % PRIME


def fingerprint(data: bytes, modulus: int = PRIME) -> int:
    whole, view = 0, np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(data), CHUNK):
        part = view[at : at + CHUNK]
        whole = combine(whole, chunk_hash(part), len(part))
    return whole % modulus


def _fingerprints(modulus: int, chunks: bool):
    """For mapInArrow over (id, text, h): with ``chunks`` a row per chunk (fp, n, at, chunk), else one per text (id, h, fp, n, sha)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run_of in texts(batch.column(1)):
                rows, held = [], 0
                for text in run_of:
                    low = text.lower()
                    fp = fingerprint(low, modulus)
                    if not chunks:
                        rows.append((fp, len(low), hashlib.sha256(low).hexdigest()))
                        continue
                    for at in range(0, max(1, len(low)), CHUNK):
                        rows.append((fp, len(low), at // CHUNK, low[at : at + CHUNK]))
                    held += len(low)
                    if held >= FLUSH:
                        yield _chunk_batch(rows)
                        rows, held = [], 0
                if chunks and rows:
                    yield _chunk_batch(rows)
                elif rows:
                    fp, n, sha = zip(*rows, strict=True)
                    ids = batch.column(0).slice(first, len(rows))
                    h = batch.column(2).slice(first, len(rows))
                    yield pa.RecordBatch.from_arrays([ids, h, pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["id", "h", "fp", "n", "sha"])

    return run


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["fp", "n", "at", "chunk"])


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = PRIME) -> DataFrame:
    """Per row of ``docs``: id, sha, keep_id, group_size, kept; materialised. ``modulus`` is lowered only by tests."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    # one narrow pass; what is kept of a text is 100 bytes
    rows = cut(source.mapInArrow(_fingerprints(modulus, False), "id long, h long, fp long, n long, sha string").withColumn("row", F.monotonically_increasing_id()))
    # only texts of groups of two or more are read again, and most of their chunks meet in the map-side aggregation
    several = rows.groupBy("fp", "n").agg(F.count("*").alias("of")).where("of > 1").select("fp", "n")
    asked = cut(rows.join(several, ["fp", "n"]).select("h").distinct())
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    pieces = source.join(F.broadcast(asked) if few else asked, "h", "left_semi").select("id", "text").mapInArrow(_fingerprints(modulus, True), "fp long, n long, at int, chunk binary")
    compared = pieces.groupBy("fp", "n", "at").agg((F.min("chunk") == F.max("chunk")).alias("same"))
    split = cut(compared.where(~F.col("same")).select("fp", "n").distinct().withColumn("split", F.lit(True)))
    keyed = rows.withColumn("key", F.lit(""))
    if not split.isEmpty():
        keyed = rows.join(split, ["fp", "n"], "left").withColumn("key", F.when(F.col("split"), F.col("sha")).otherwise(F.lit(""))).drop("split")
    last = F.struct(F.col("id").isNotNull().alias("given"), "id", "row")
    groups = keyed.groupBy("fp", "n", "key").agg(F.max(last).alias("last"), F.count("*").alias("group_size"))
    return cut(
        keyed.join(groups, ["fp", "n", "key"]).select("id", "sha", F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"))
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged."""
    found = decisions(docs, id_col, text_col)
    # a key stays when one of its rows does; rows that repeat a whole key are reduced to one below
    keys = found.groupBy("id", "sha").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    on = {"id": F.col(id_col).cast("long"), "sha": F.sha2(ascii_lower(F.col(text_col).cast("string")), 256)}
    kept = without(docs, cut(keys.where(~F.col("stays")).select("id", "sha")), on)
    again = cut(keys.where(F.col("stays") & (F.col("n") > 1)).select("id", "sha"))
    if again.isEmpty():
        return kept
    names = fresh(docs, *on)
    twice = without(kept, again, on, "left_semi").select("*", *[on[c].alias(n) for c, n in zip(on, names, strict=True)])
    return without(kept, again, on).unionByName(twice.dropDuplicates(names).drop(*names))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, keep_id, group_size, kept, text_sha256."""
    return decisions(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
