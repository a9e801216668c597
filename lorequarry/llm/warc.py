"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads.

Shards are ranges of (page id, payload digest). The range sort of ids and sizes gives every record the exact number of
bytes before it, whatever partitions the sort chose, and a shard begins where these pass a multiple of the shard's size. So
the ranges depend on the data alone, far-off ids and many records of one id change nothing, and any run over equal rows
makes equal files. Within a shard, records follow page ids; a file is rolled when its compressed size reaches a limit. Each
record is a gzip member of its own with headers and digests made anew. A task writes under a temporary name that no other
attempt shares and then moves the file to its final name, which ends in a digest of its bytes; a retried or doubled task
makes the same name and leaves a finished file alone. The manifest, written by Spark's own commit, is what makes files part
of the archive: readers open what it lists and nothing else.

The first page (the smallest id) of equal payloads of at least ``LEAST_REVISIT`` bytes is a response, the others revisit it.

Defined results: null html is an empty payload; a null url is named after its page; control characters and spaces of urls
are percent-encoded; null ids come first, in shard 0, and are always responses; rows that repeat the smallest id of a
payload are all responses; rows that repeat an id and its payload lie in one shard; an empty table makes an empty manifest;
other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.session import checkpoint_dir, cut

#: Shards are larger than SHARD_BYTES where there would be more than SHARDS, which bounds the list of their first keys.
SHARDS = 1 << 16
SHARD_BYTES, FILE_BYTES = 64 << 20, 32 << 20
LEAST_REVISIT = 100
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, number int, records long, bytes long, sha256 string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def filesystem(path: str):
    """The file system and the path within it of a URI as Hadoop writes them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else f"file://{path}")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id} {digest}'.encode()).hexdigest()[:32], version=5)}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, whole: headers, block and the two line ends after it."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in headers), "\r\n"]).encode() + block + b"\r\n\r\n"


class _File:
    """An open archive file under a temporary name."""

    def __init__(self, path: str, shard: int, number: int):
        self.fs, self.root = filesystem(path)
        self.shard, self.number = shard, number
        self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}"
        self.fs.create_dir(self.temporary)
        self.out = self.fs.open_output_stream(f"{self.temporary}/open", compression=None)
        self.sha, self.size, self.records = hashlib.sha256(), 0, 0

    def add(self, data: bytes) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records = self.size + len(member), self.records + 1

    def commit(self) -> tuple:
        from pyarrow import fs

        self.out.close()
        name = f"part-{self.shard:05d}-{self.number:05d}-{self.sha.hexdigest()[:16]}.warc.gz"
        if self.fs.get_file_info(f"{self.root}/{name}").type == fs.FileType.NotFound:  # else another attempt's, of the same bytes
            self.fs.move(f"{self.temporary}/open", f"{self.root}/{name}")
        self.fs.delete_dir(self.temporary)
        return name, self.shard, self.number, self.records, self.size, self.sha.hexdigest()


def _write(path: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, refers, done = None, {}, []
        at = None
        for batch in batches:
            shards, ids, digests, refers_to, urls = (batch.column(k).to_pylist() for k in range(5))
            for k, (shard, page_id, digest) in enumerate(zip(shards, ids, digests, strict=True)):
                if page_id != at:
                    at, refers = page_id, {}
                payload = batch.column(5)[k].as_py()
                if payload is None:  # says that the rows of this page with this digest are revisits
                    refers[digest] = refers_to[k]
                    continue
                if file and (file.shard != shard or file.size >= file_bytes):
                    done.append(file.commit())
                    file = _File(path, shard, file.number + 1 if file.shard == shard else 0)
                file = file or _File(path, shard, 0)
                file.add(record(page_id, urls[k], payload, hashlib.sha256(payload).hexdigest(), refers.get(digest)))
        if file:
            done.append(file.commit())
        if done:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    return run


def first_keys(keyed: DataFrame, shard_bytes: int) -> list[tuple[int, str]]:
    """The first (page id, digest) of every shard but shard 0, of rows (page_id, digest, n)."""
    total = keyed.agg(F.sum(F.col("n") + 500)).first()[0] or 0
    size = max(shard_bytes, -(-total // SHARDS))
    rows = keyed.where("page_id IS NOT NULL").select("page_id", "digest", (F.col("n") + 500).alias("bytes"))
    ordered = cut(rows.repartitionByRange("page_id", "digest").sortWithinPartitions("page_id", "digest").withColumn("p", F.spark_partition_id()))
    before = ordered.groupBy("p").agg(F.min(F.struct("page_id", "digest")).alias("first"), F.sum("bytes").alias("bytes"))
    before = before.select("p", (F.sum("bytes").over(Window.orderBy("first")) - F.col("bytes")).alias("before"))  # a row per partition
    own = F.sum("bytes").over(Window.partitionBy("p").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    placed = ordered.withColumn("own", own).join(F.broadcast(before), "p")
    firsts = placed.groupBy(F.floor((F.col("before") + F.col("own")) / size).alias("shard")).agg(F.min(F.struct("page_id", "digest")).alias("first"))
    found = sorted({(r.first.page_id, r.first.digest) for r in firsts.where("shard > 0").select("first").collect()})  # at most SHARDS rows
    return found


def shard_column(page_id: F.Column, digest: F.Column, firsts: list[tuple[int, str]]) -> F.Column:
    """The number of shards that begin at or before a record."""
    import numpy as np

    ids, digests = np.array([i for i, _ in firsts], dtype=np.int64), [d for _, d in firsts]

    def place(page: pd.Series, of: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(ids, page.to_numpy(), side) for side in ("left", "right"))
        for k in np.flatnonzero(low < high).tolist():  # a shard begins within this id
            high[k] = bisect.bisect_right(digests, of.iloc[k], int(low[k]), int(high[k]))
        return pd.Series(high.astype("int32"))

    return F.pandas_udf(place, "int")(F.coalesce(page_id, F.lit(-(1 << 63))), digest)


def write(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html) under ``path``; returns the manifest as read back."""
    spark: SparkSession = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    payload = F.encode(html, "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.octet_length(html).cast("long").alias("n"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keyed = cut(rows.select("page_id", "n", "digest"))  # 100 bytes a page
    long = keyed.where(F.col("n") >= LEAST_REVISIT)
    first = long.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    refers = long.join(first, ["digest", "n"]).where("page_id > first").select("page_id", "digest", "first").distinct()
    firsts = first_keys(keyed, shard_bytes)
    # the payloads move once; which of them are revisits travels beside them as rows without payload, sorted first
    columns = lambda refers_to, url, body: ["page_id", "digest", refers_to.cast("long").alias("refers_to"), url.cast("string").alias("url"), body.cast("binary").alias("payload")]
    none = F.lit(None)
    stream = rows.select(*columns(none, F.col("url"), F.col("payload"))).unionByName(refers.select(*columns(F.col("first"), none, none)))
    dealt = stream.select(shard_column(F.col("page_id"), F.col("digest"), firsts).alias("shard"), "page_id", "digest", "refers_to", "url", "payload")
    sorted_ = dealt.repartitionById(len(firsts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", F.col("payload").isNotNull(), "digest", "url")
    sorted_.mapInArrow(_write(path, file_bytes), MANIFEST).write.parquet(f"{path}/_manifest")
    store, root = filesystem(path)
    store.create_dir(f"{root}/_temporary")
    store.delete_dir(f"{root}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    for data in chunks:
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple:
    """(page_id, payload bytes, payload digest, type, refers_to) of a record, its lengths and digests checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"a damaged record: {headers.get('WARC-Record-ID')}")
    kind, digest, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
            raise ValueError(f"a payload that differs from its digest: {headers['WARC-Record-ID']}")
    number = lambda name: int(headers[name]) if headers.get(name) else None
    return number("X-Page-Id"), size, digest, kind, number("X-Refers-To-Page")


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for data in members(iter(lambda f=f: f.read(1 << 20), b"")):
                        rows.append(parse(data))
                        seen += 1
                        if len(rows) >= 5000:
                            yield make(rows)
                            rows = []
                if seen != expected:
                    raise ValueError(f"{name} has {seen} records, the manifest says {expected}")
                if rows:
                    yield make(rows)

    return run


def read(manifest: DataFrame, path: str) -> DataFrame:
    """The records of the files that a manifest lists, each checked as it streams by; every file is a task's own."""
    files = manifest.count()
    return manifest.select("file", "records").repartition(max(1, files)).mapInArrow(_read(path), READ)


def digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The contract's rows, read back from an archive written in the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, path), path)
