"""Sources and sinks: file trees, JSON logs, vector shards, stable writes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE, CAP = 8192, 2_000_000
MAGIC = b"VECTI8\0\1"


def tree(spark: SparkSession, root: str, deny: str | None = None, cap: int = CAP, content: bool = True) -> DataFrame:
    """(path, size, modified, state, text) of every file below a folder; without ``content`` no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    rows = rows.where(~F.col("path").rlike(deny)) if deny else rows
    if not content:
        return rows
    binary = F.instr(F.substring("content", 1, PROBE).cast("string"), "\0") > 0
    state = F.when(F.col("size") > cap, "too_large").when(binary, "binary").when(~F.is_valid_utf8(F.col("content").cast("string")), "latin1").otherwise("text")
    text = F.when(state == "text", F.decode("content", "UTF-8")).when(state == "latin1", F.decode("content", "ISO-8859-1"))
    return rows.select("path", "size", "modified", state.alias("state"), text.alias("text"))


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log; lines that do not parse are dropped."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path).cache().where("_corrupt_record IS NULL").drop("_corrupt_record")


def content_token(rows: DataFrame, volatile: tuple[str, ...] = ()) -> str:
    """A digest of a table's rows in any order, without the volatile columns."""
    kept = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns) if c not in volatile]
    n, total = rows.select(F.xxhash64(*kept).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return f"{n}:{total}"


def stable_write(rows: DataFrame, path: str, volatile: tuple[str, ...] = ()) -> bool:
    """Write Parquet unless the folder holds equal rows already; says whether it wrote."""
    spark = rows.sparkSession
    try:
        held = content_token(spark.read.parquet(path), volatile)
    except AnalysisException:
        held = None  # nothing there yet
    if held == content_token(rows, volatile):
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def write_sharded_json(rows: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder of JSON lines per shard."""
    rows.repartition(shard).sortWithinPartitions(*[c for c in rows.columns if c != shard][:1]).write.partitionBy(shard).mode("overwrite").json(path)


def pack_shard(ids: list[bytes], codes: np.ndarray, scales: list[float], offsets: list[float]) -> bytes:
    """A vector shard: magic, dimension and count, then id, scale, offset and codes of each row."""
    head = MAGIC + struct.pack("<II", codes.shape[1] if codes.size else 0, len(ids))
    return head + b"".join(i + struct.pack("<ff", s, o) + c.tobytes() for i, c, s, o in zip(ids, codes.astype(np.uint8), scales, offsets, strict=True))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(id, scale, offset, codes) of vector shards, each file checked and decoded by itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                data = bytes(data)
                dims, n = struct.unpack_from("<II", data, 8)
                size = 24 + dims
                if data[:8] != MAGIC or len(data) != 16 + n * size:
                    raise ValueError("a damaged vector shard")
                rows = [(data[a : a + 16].hex(), *struct.unpack_from("<ff", data, a + 16), list(data[a + 24 : a + size])) for a in range(16, len(data), size)]
                yield pd.DataFrame(rows, columns=["id", "scale", "offset", "codes"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id string, scale float, offset float, codes array<int>")
