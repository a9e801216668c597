"""A versioned store of quantised vectors: id-prefix shards in sorted part files, and a manifest.

A row is 16 bytes of id, scale and offset as little-endian floats, and a byte per dimension; a file starts with a magic word,
the dimension and its count. Rows are range-sorted by shard and id, and a task writes a file per ``PART`` rows, so a shard of
any size needs no task of its own. A file's name ends in the digest of its bytes and appears by renaming: writing the same
rows again changes nothing. The manifest is written last, by Spark, and names the files that count.

Defined results: an id is 32 hexadecimal digits, other rows are refused; codes are cut or filled with zeros to the dimension;
of rows with one id the first by codes stays; a store of another model or dimension gives no rows; a damaged file is refused
alone; rows whose scale or offset is not finite are left out and counted; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.session import cut
from lorequarry.sources.files import MAGIC

SHARDS, PART = 16, 1 << 18
MANIFEST = "model string, dim int, shards int, shard int, file string, count long, sha string"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _row(dim: int) -> np.dtype:
    return np.dtype([("id", "u1", 16), ("scale", "<f4"), ("offset", "<f4"), ("codes", "u1", (dim,))])


def _files(path: str, dim: int):
    """(shard, id, scale, offset, codes), sorted, to files of at most PART rows; one row per file."""

    def put(shard: int, held: list[tuple]) -> dict:
        rows = np.zeros(len(held), dtype=_row(dim))
        for k, (i, scale, offset, codes) in enumerate(held):
            rows[k] = (np.frombuffer(bytes.fromhex(i), dtype="u1"), scale, offset, np.resize(np.array([*codes[:dim], *[0] * dim][:dim], dtype="u1"), dim))
        data = MAGIC + struct.pack("<II", dim, len(rows)) + rows.tobytes()
        sha = hashlib.sha256(data).hexdigest()
        fs, base = _opened(path)
        name = f"shard-{shard:02x}-{sha[:16]}.i8"
        if fs.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
            fs.create_dir(base, recursive=True)
            temporary = f"{base}/.{name}.{np.random.default_rng().integers(1 << 62):x}"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, f"{base}/{name}")
        return {"shard": shard, "file": name, "count": len(rows), "sha": sha}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (shard != now or len(held) >= PART):
                    yield pa.RecordBatch.from_pylist([put(now, held)], schema=kinds)
                    held = []
                now = shard
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([put(now, held)], schema=kinds)

    kinds = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("count", pa.int64()), ("sha", pa.string())])
    return run


def write_store(rows: DataFrame, path: str, model: str, dim: int, shards: int = SHARDS) -> DataFrame:
    """Writes rows (id, scale, offset, codes); returns the manifest."""
    good = rows.where(F.col("id").rlike("^[0-9a-fA-F]{32}$") & F.col("codes").isNotNull()).groupBy(F.lower("id").alias("id")).agg(F.min(F.struct("codes", "scale", "offset")).alias("x"))
    number = F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % shards
    placed = good.select(number.alias("shard"), "id", F.col("x.scale").cast("float").alias("scale"), F.col("x.offset").cast("float").alias("offset"), F.col("x.codes").cast("array<int>").alias("codes"))
    files = placed.repartitionByRange("shard", "id").sortWithinPartitions("shard", "id").mapInArrow(_files(path, dim), "shard int, file string, count long, sha string")
    manifest = cut(files.select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), F.lit(shards).alias("shards"), "shard", "file", "count", "sha"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")  # a row per file
    return manifest


def read_store(spark: SparkSession, path: str, model: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, scale, offset, codes), and a report (file, status, rows, skipped) of each file of the manifest.

    ``status`` is ok, damaged, missing, or another model; only files that are ok give rows.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    fits = (F.col("model") == model) & (F.col("dim") == dim)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, count, sha in frame.itertuples(index=False):
                fs, base = _opened(path)
                if fs.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
                    yield pd.DataFrame([(name, "missing", None, None, None, None)], columns=columns)
                    continue
                with fs.open_input_stream(f"{base}/{name}") as f:
                    data = f.read()
                head = len(MAGIC)
                sound = hashlib.sha256(data).hexdigest() == sha and data[:head] == MAGIC and struct.unpack_from("<II", data, head) == (dim, count) and len(data) == head + 8 + count * _row(dim).itemsize
                if not sound:
                    yield pd.DataFrame([(name, "damaged", None, None, None, None)], columns=columns)
                    continue
                rows = np.frombuffer(data, dtype=_row(dim), offset=head + 8)
                finite = np.isfinite(rows["scale"]) & np.isfinite(rows["offset"])
                state = np.where(finite, "ok", "skipped")
                yield pd.DataFrame({"file": name, "status": state, "id": [bytes(i).hex() for i in rows["id"]], "scale": rows["scale"], "offset": rows["offset"], "codes": list(rows["codes"].astype(int))}, columns=columns)

    columns = ["file", "status", "id", "scale", "offset", "codes"]
    asked = manifest.where(fits).select("file", "count", "sha")
    read = asked.repartition("file").mapInPandas(run, "file string, status string, id string, scale float, offset float, codes array<int>")
    seen = read.groupBy("file").agg(F.max(F.when(F.col("status").isin("damaged", "missing"), F.col("status"))).alias("bad"), F.count_if(F.col("status") == "ok").alias("rows"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    report = manifest.join(seen, "file", "left").select("file", F.when(~fits, "another model").otherwise(F.coalesce("bad", F.lit("ok"))).alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("skipped", F.lit(0)).alias("skipped"))
    return read.where("status = 'ok'").select("id", "scale", "offset", "codes"), report
