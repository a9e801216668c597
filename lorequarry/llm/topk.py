"""Exact top-k by inner product with a Voronoi join.

A bounded sample gives pivots; every row goes to its nearest pivot's cell. Per cell a summary keeps the smallest distances
to the pivot, of rows of distinct ids. From summaries alone each query gets a score that its k-th best of other ids surely
reaches: a row at distance d from
pivot p scores between q.p - |q| d and q.p + |q| d. Per group of queries and cell follows the least distance from the
pivot at which a row can still matter to any query of the group; only such rows are replicated to the group. Groups are
solved locally, by blocks of at most about ``BLOCK`` rows, and the blocks' best are merged. Bounds carry a slack above any
rounding, so results are exact whatever the pivots.

Components become floor(256 x) with x as double. Defined results: rows whose vector is null, holds a null or a non-finite
component, or has another length than most take no part; ties go to the smaller id; rows that share the query's id count
as its own; a query row that repeats is answered each time; a null id is a candidate after all others and never a query;
fewer candidates than k are all returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.session import cut

K = 5
#: Pivots are the square root of the rows, within these bounds; groups of queries are at most GROUPS. Together they bound what the driver holds.
PIVOTS, GROUPS = (128, 2048), 1024
GROUP_QUERIES, BLOCK = 512, 32_768
SLACK = 0.5
_EXACT = 1 << 53


def quantised(rows: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """(id, vec) and ``more`` of the rows that take part: integers floor(256 x) in vectors of the commonest length."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    good = rows.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long")).alias("vec"), *more)
    size = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("vec") == (size.n if size else 0))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim) if dim else np.zeros((len(column), 0), dtype=np.int64)


def _cells(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(1) / 2
        for batch in batches:
            x = _matrix(batch.column(1), pivots.shape[1]).astype(float)
            cell = np.argmin(half - x @ pivots.T, axis=1)
            d = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d)], ["id", "vec", "cell", "d"])

    return run


def _needs(pivots: np.ndarray, cells: np.ndarray, distances: np.ndarray, ids: list, k: int):
    """Per query (row, id, vec, grp): what distance from each pivot a row must have to matter, least per group and batch."""
    held = np.array(ids, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(2), pivots.shape[1]).astype(float)
            norm = np.sqrt((q**2).sum(1))
            to = q @ pivots.T
            floor = to[:, cells] - norm[:, None] * distances
            # rows that share the query's id don't count; of k + 1 distinct ids a cell, k are left
            floor[batch.column(1).to_numpy()[:, None] == held] = -np.inf
            sure = np.sort(floor, axis=1)[:, -k] if floor.shape[1] >= k else np.full(len(q), -np.inf)
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(norm[:, None] > 0, (sure[:, None] - SLACK - to) / norm[:, None], -np.inf)
            grp = np.array(batch.column(3).to_pylist())
            for g in np.unique(grp):
                t = least[grp == g].min(0)
                yield pa.RecordBatch.from_arrays([pa.array([int(g)] * len(t), pa.int32()), pa.array(np.arange(len(t), dtype=np.int32)), pa.array(t)], ["grp", "cell", "least"])

    return run


def _replicate(least: np.ndarray, groups: np.ndarray, blocks: int):
    """Rows (id, vec, cell, d) to (grp, block, id, vec) for each group that may need them; blocks are dealt in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() if TaskContext.get() else 0
        for batch in batches:
            cell, d = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            block = (turn + np.arange(len(d), dtype=np.int64)) % blocks
            turn += len(d)
            for g, row in zip(groups.tolist(), least, strict=True):
                at = pa.array(np.flatnonzero(d >= row[cell] - 1e-6))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.int32()), pa.array(block).take(at), batch.column(0).take(at), batch.column(1).take(at)], ["grp", "block", "id", "vec"])

    return run


def _solve(dim: int, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, x = _matrix(queries.column("vec"), dim), _matrix(rows.column("vec"), dim)
        q_row, q_id = queries.column("row").to_pylist(), queries.column("id").to_pylist()
        ids = np.array([math.inf if i is None else i for i in rows.column("id").to_pylist()], dtype=object)
        order = np.array(sorted(range(len(ids)), key=ids.__getitem__), dtype=int)
        x, ids = x[order], ids[order]
        out = []
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(q).max(initial=0)))
        exact = dim * most * most < _EXACT
        xs = x.astype(float) if exact else x
        for at in range(0, len(q), 64):
            part = q[at : at + 64]
            scores = (part.astype(float) @ xs.T).astype(np.int64) if exact else part @ xs.T
            for j, s in enumerate(scores):
                own = q_id[at + j]
                some = min(len(s), k + 1 + int((ids == own).sum()))
                if not some:
                    continue
                edge = np.partition(s, -some)[-some]
                # rows lie in order of id, so of equal scores the first found have the smallest ids
                above, tied = np.flatnonzero(s > edge), np.flatnonzero(s == edge)[:some]
                best = sorted(((-int(s[i]), int(i)) for i in [*above, *tied] if ids[i] != own))[:k]
                out += [(q_row[at + j], own, None if ids[i] is math.inf else int(ids[i]), -s_) for s_, i in best]
        kinds = [pa.int64()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], ["row", "query_id", "vec_id", "score"])

    return run


def chained(points: np.ndarray) -> np.ndarray:
    """The place of each pivot in a chain that always goes on to the nearest pivot not yet in it."""
    place, now, left = np.zeros(len(points), dtype=int), 0, np.ones(len(points), dtype=bool)
    for k in range(len(points)):
        place[now], left[now] = k, False
        if left.any():
            now = int(np.where(left, ((points - points[now]) ** 2).sum(1), np.inf).argmin())
    return place


def dealt(rows: DataFrame, queries, k: int, id_col: str, vector_col: str, pivots: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Queries (row, id, vec, grp, block), the rows that each group needs (grp, block, id, vec), and the dimension.

    Every group's rows are dealt into ``ceil(rows / BLOCK)`` blocks, and its queries meet each of them.
    """
    good = quantised(rows, id_col, vector_col)
    pivots = pivots or min(max(math.isqrt(good.count()), PIVOTS[0]), PIVOTS[1])
    found = good.orderBy(F.xxhash64("id", "vec")).limit(pivots).select("vec").collect()  # a bounded sample; any pivots give exact results
    points = np.unique(np.array([r.vec for r in found], dtype=float), axis=0) if found else np.zeros((1, 0))
    dim = points.shape[1]
    placed = cut(good.mapInArrow(_cells(points), "id long, vec array<long>, cell int, d double"))
    n = placed.count()
    near = Window.partitionBy("cell").orderBy("d")
    apart = placed.groupBy("cell", "id").agg(F.min("d").alias("d"))
    summary = apart.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).select("cell", "id", "d").collect()  # k + 1 rows a pivot
    cells, distances = np.array([r.cell for r in summary], dtype=int), np.array([r.d for r in summary], dtype=float)
    asked = placed.where(queries & F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    # groups are runs of cells along a chain of near pivots, so that one bound serves a group's queries; at most GROUPS
    of_cell = dict(asked.groupBy("cell").count().collect())  # at most a row per pivot
    total, chain = sum(of_cell.values()), np.argsort(chained(points))
    size, grp, first = max(GROUP_QUERIES, math.ceil(2 * total / GROUPS)), 0, {}
    held, parts = 0, {}
    for c in chain.tolist():
        of = of_cell.get(c, 0)
        if held and held + of > size:
            grp, held = grp + 1, 0
        first[c], parts[c] = grp, max(1, math.ceil(of / size))
        held += of
        if parts[c] > 1:
            grp, held = grp + parts[c], 0
    table = F.create_map(*[F.lit(int(x)) for c in chain.tolist() for x in (c, first[c])])
    split = F.create_map(*[F.lit(int(x)) for c in chain.tolist() for x in (c, parts[c])])
    spread_ = F.pmod(F.xxhash64("row"), F.element_at(split, F.col("cell")))
    grouped = cut(asked.select("row", "id", "vec", (F.element_at(table, F.col("cell")) + spread_).cast("int").alias("grp")))
    needs = grouped.mapInArrow(_needs(points, cells, distances, [r.id for r in summary], k), "grp int, cell int, least double").groupBy("grp", "cell").agg(F.min("least").alias("least"))
    bounds = needs.toArrow()  # a number per group and pivot: at most GROUPS x PIVOTS[1] of them, 32 MB
    groups, place = np.unique(bounds.column("grp").to_numpy(), return_inverse=True)
    least = np.full((len(groups), len(points)), -np.inf)
    least[place, bounds.column("cell").to_numpy()] = bounds.column("least").to_numpy()
    blocks = max(1, math.ceil(n / BLOCK))
    sent = placed.mapInArrow(_replicate(least, groups, blocks), "grp int, block long, id long, vec array<long>")
    met = grouped.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return met, sent, dim


def top_k(rows: DataFrame, queries, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``queries`` (a column over ``id``) holds, its k best others."""
    met, sent, dim = dealt(rows, queries, k, id_col, vector_col, pivots)
    local = met.groupBy("grp", "block").cogroup(sent.groupBy("grp", "block")).applyInArrow(_solve(dim, k), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: queries are the rows whose vec_id is divisible by 50."""
    return top_k(embeddings, F.col("id") % 50 == 0)
