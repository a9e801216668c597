"""A growing log as a stream of its lines, and changes held back until a quiet period has passed.

``log_tail`` is a data source. Its offset is the signature of a file, the digest of its first line, and the place after its
last complete line: a partial last line waits. A file whose signature changed was rotated: what was left of the old one is
read from the rotated names (``path.1`` and on) by its signature, then the new one from its start. A file that is shorter
than the offset was truncated and starts again. Byte ranges are dealt to tasks, and a line belongs to the range in which it
starts. Offsets name files by signature, so a batch that is run again after a rotation reads the same bytes.

Defined results: a missing or empty file, or one without a complete line, has no rows; bytes that are not UTF-8 are replaced;
empty lines are rows; a truncated file that grew beyond the old offset with the same first line is taken for the old one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

STEP = 1 << 16
#: Rotated names that are looked at, and bytes of a task's range.
ROTATED, RANGE = 9, 32 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


class _File:
    """One file of a shared store: size, signature, last complete line, bytes."""

    def __init__(self, path: str):
        self.fs, self.path = _opened(path)
        info = self.fs.get_file_info(self.path)
        self.size = info.size if info.type == pafs.FileType.File else -1

    def read(self, start: int, stop: int) -> bytes:
        if stop <= start:
            return b""
        with self.fs.open_input_file(self.path) as f:
            return f.read_at(stop - start, start)

    def signature(self) -> str | None:
        """Digest of the first line, or None without a complete one."""
        held = hashlib.sha256()
        for at in range(0, max(self.size, 0), STEP):
            part = self.read(at, min(self.size, at + STEP))
            end = part.find(b"\n")
            held.update(part if end < 0 else part[:end])
            if end >= 0:
                return held.hexdigest()
        return None

    def complete(self) -> int:
        """The place after the last line end."""
        stop = self.size
        while stop > 0:
            start = max(0, stop - STEP)
            end = self.read(start, stop).rfind(b"\n")
            if end >= 0:
                return start + end + 1
            stop = start
        return 0


class _Range(InputPartition):
    def __init__(self, path: str, signature: str, first: int, start: int, stop: int, end: int):
        self.path, self.signature, self.first, self.start, self.stop, self.end = path, signature, first, start, stop, end


class _Tail(DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"signature": "", "offset": 0}

    def latestOffset(self) -> dict:
        file = _File(self.path)
        signature = file.signature()
        return {"signature": signature, "offset": file.complete()} if signature else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["signature"] == end["signature"] and start["offset"] <= end["offset"]:
            return self._ranges(end["signature"], start["offset"], end["offset"])
        # rotated or truncated: first the rest of the old file, if a rotated name still has it
        old = self._named(start["signature"], rotated=True) if start["signature"] and start["signature"] != end["signature"] else None
        rest = self._ranges(start["signature"], start["offset"], _File(old).complete()) if old else []
        return rest + self._ranges(end["signature"], 0, end["offset"])

    def _named(self, signature: str, rotated: bool = False) -> str | None:
        for name in [*([] if rotated else [self.path]), *(f"{self.path}.{k}" for k in range(1, ROTATED + 1)), *([self.path] if rotated else [])]:
            if _File(name).signature() == signature:
                return name
        return None

    def _ranges(self, signature: str, start: int, end: int) -> list[InputPartition]:
        name = self._named(signature) if signature and end > start else None
        return [_Range(name, signature, start, at, min(end, at + self.size), end) for at in range(start, end, self.size)] if name else []

    def read(self, partition: _Range) -> Iterator[tuple]:
        file, at, held = _File(partition.path), partition.start, b""
        if file.signature() != partition.signature:  # rotated since the ranges were dealt
            name = self._named(partition.signature)
            if name is None:
                raise FileNotFoundError(f"{partition.path}: rotated away before it was read")
            file = _File(name)
        if at > partition.first:  # the line that runs into this range belongs to the one before
            back = file.read(at - 1, at)
            while back != b"\n" and at < partition.end:
                part = file.read(at, min(partition.end, at + STEP))
                end = part.find(b"\n")
                at, back = (at + end + 1, b"\n") if end >= 0 else (at + len(part), back)
        place = at
        while place < partition.stop and (at < partition.end or held):
            part = file.read(at, min(partition.end, at + STEP))
            at += len(part)
            *lines, held = (held + part).split(b"\n")
            for line in lines:
                if place >= partition.stop:
                    return
                yield line.decode(errors="replace"), partition.signature, place
                place += len(line) + 1


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").load(path)``: line, signature of its file, and offset in it."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "line string, signature string, offset long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Tail(self.options["path"], int(self.options.get("range_bytes", RANGE)))


def debounce(changes: DataFrame, quiet_ms: int = 1500, most: int = 500, delay: str = "0 seconds") -> DataFrame:
    """(key, first, last, n, paths): bursts of a stream of changes (key, path, ts) that were followed by a quiet period.

    Each change starts the period again. Batches of more than ``most`` distinct paths come in several rows. A burst is handed
    on when a later change of its key, or the watermark, shows that its period is over; until then it is state.
    """
    columns = ["key", "first", "last", "n", "paths"]

    def rows(key, burst: tuple) -> Iterator[list]:
        first, last, n, paths = burst
        for at in range(0, len(paths), most):
            yield [key, first, last, n, paths[at : at + most]]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            burst = state.get
            state.remove()
            yield pd.DataFrame(list(rows(key[0], (burst[0], burst[1], burst[2], list(burst[3])))), columns=columns)
            return
        held, out = state.get if state.exists else None, []
        events = sorted((int(ms), p) for frame in frames for ms, p in zip(frame["ms"], frame["path"], strict=True))
        if held is not None and events and events[0][0] < held[0]:
            held = (events[0][0], *held[1:])
        paths = dict.fromkeys(held[3]) if held is not None else {}
        for ms, path in events:
            if held is not None and ms - held[1] > quiet_ms:
                out += rows(key[0], (*held[:3], list(paths)))
                held = None
            if held is None:
                held, paths = (ms, ms, 0, None), {}
            held = (held[0], max(held[1], ms), held[2] + 1, None)
            paths[path] = None
        if held is not None:
            state.update((held[0], held[1], held[2], list(paths)))
            state.setTimeoutTimestamp(max(held[1] + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    held = changes.withWatermark("ts", delay).select("key", "path", "ts", F.unix_millis("ts").alias("ms"))
    return held.groupBy("key").applyInPandasWithState(
        update, "key string, first long, last long, n long, paths array<string>", "first long, last long, n long, paths array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def debounced(changes: DataFrame, quiet_ms: int = 1500) -> DataFrame:
    """(key, first, last, n): the bursts of a finished table of changes."""
    burst = changes.withColumn("ts", F.date_trunc("millisecond", "ts")).groupBy("key", F.session_window("ts", f"{quiet_ms + 1} milliseconds").alias("w"))
    return burst.agg(F.unix_millis(F.min("ts")).alias("first"), F.unix_millis(F.max("ts")).alias("last"), F.count("*").alias("n")).drop("w")
