"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lorequarry.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a side that may be broadcast: ids and a digest take under 100 bytes a row, so 20 MB at most.
BROADCAST_ROWS = 200_000

#: Rows of narrow columns that a task should at least have: every task of a shuffle writes a file with a block per partition.
TASK_ROWS = 250_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def texts(column: pa.Array, most: int = 1 << 24) -> Iterator[tuple[int, list[bytes]]]:
    """UTF-8 texts of an Arrow column with the row of the first, in runs of about ``most`` bytes; nulls are empty."""
    n, first = len(column), 0
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    held, size = [], 0
    for i in range(n):
        value = column[i].as_py() or b""
        held.append(value)
        size += len(value)
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def cut_narrow(df: DataFrame, *observed: Column, weight: int = 1) -> tuple[DataFrame, tuple]:
    """A table of ids, hashes or links, cut and read in as many tasks as its rows ask for; and its count, then ``observed``.

    A large table keeps its partitions: tasks are merged only below ``TASK_ROWS`` rows each, without a shuffle; a row that
    the next step turns into ``weight`` rows counts as that many.
    """
    seen = Observation()
    held = cut(df.observe(seen, F.count("*").alias("n"), *[c.alias(f"c{i}") for i, c in enumerate(observed)]))
    found = (seen.get["n"], *(seen.get[f"c{i}"] for i in range(len(observed))))
    return held.coalesce(1 + found[0] * weight // TASK_ROWS), found


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``docs`` has, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column], how: str = "left_anti") -> DataFrame:
    """``docs`` less the rows whose keys (null-safe) are in ``dropped``, which is already materialised.

    ``keys`` gives each column of ``dropped`` its expression over ``docs``. A short list is broadcast, so that the texts need
    no shuffle; a longer one goes through a shuffled anti join. With ``how="left_semi"`` those rows stay instead.
    """
    few = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    names = dict(zip(keys, fresh(docs, *(f"gone_{i}" for i in range(len(keys)))), strict=True))
    held = dict(zip(keys, fresh(docs, *(f"held_{i}" for i in range(len(keys)))), strict=True))
    gone = dropped.select(*[F.col(c).alias(n) for c, n in names.items()])
    marked = docs.select("*", *[keys[c].alias(n) for c, n in held.items()])
    same = None
    for c in keys:
        one = F.col(held[c]).eqNullSafe(F.col(names[c]))
        same = one if same is None else same & one
    return marked.join(F.broadcast(gone) if few else gone, same, how).drop(*held.values())
