"""Hard-negative mining with bounds along a spanning tree of anchors.

Anchors are taken in rounds of at most ``ROUND`` and broadcast, and every round reads all rows. Within a round a minimum
spanning tree joins the anchors. A task takes rows in blocks and walks the tree: the root's scores are exact, and for a
child anchor at distance e from its parent, a row of norm r scores within e r of its score at the parent, so

    low(child) = low(parent) - e r,    high(child) = high(parent) + e r.

Only rows whose interval meets the anchor's window are scored again, and exact scores tighten what goes on down the tree.
First the positives: the window reaches from the anchor's k-th best score so far upwards, among rows of its own label. Then
the negatives, by the same walk: the window is the union of the positives' ranges, less what the best found so far rule out,
among rows of other labels. A task hands on at most k rows per anchor, or per anchor and positive, and windows choose among
tasks. Intervals have a slack above any rounding, so results are exact whatever the tree.

Heavy children are visited last and parents let go before them, so a task holds intervals of at most log2(ROUND) anchors.

Defined results: rows with a null label, a null vector or a null or non-finite component, or a vector of another length than
most, take no part; where the id is divisible by 7 the label moves on by one, modulo 10; components become floor(256 x);
rows that share the anchor's id count as the anchor's own and are neither positives nor negatives; an anchor row that repeats
is answered each time; a null id is a candidate after all others and never an anchor; fewer candidates are all returned; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.llm.topk import _EXACT, quantised
from lorequarry.session import cut

POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Anchors that a task holds at a time, with their positives, and rows that it bounds at a time.
ROUND, ROWS = 4096, 8192
_NONE = np.iinfo(np.int64).max  # a null id, after all others


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): a minimum spanning tree by Prim's rule, as a walk from the first point, heavy children last."""
    n = len(points)
    parent, near, left = np.full(n, -1), np.full(n, np.inf), np.ones(n, dtype=bool)
    joined, now = [], 0
    for _ in range(n):
        left[now] = False
        joined.append(now)
        d = np.sqrt(((points - points[now]) ** 2).sum(1))
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], now
        if left.any():
            now = int(np.where(left, near, np.inf).argmin())
    weight = np.ones(n, dtype=int)
    children: list[list[int]] = [[] for _ in range(n)]
    for v in reversed(joined[1:]):
        weight[parent[v]] += weight[v]
    for v in joined[1:]:
        children[parent[v]].append(v)
    order, open_ = [], [0] if n else []
    while open_:
        v = open_.pop()
        order.append(v)
        open_ += sorted(children[v], key=weight.__getitem__, reverse=True)  # the heaviest is at the bottom, so it comes last
    return np.array(order, dtype=int), parent, np.where(parent < 0, 0.0, near)


class Walk:
    """Scores of one block of rows along the tree, where a window asks for them."""

    def __init__(self, anchors: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.order, self.parent, self.edge = (x.tolist() for x in tree)
        self.anchors, self.most = anchors, int(np.abs(anchors).max(initial=0))
        children = np.bincount(tree[1][tree[1] >= 0], minlength=len(anchors))
        self.children = children.tolist()
        self.met = self.rescored = 0

    def run(self, x: np.ndarray, window, keep) -> None:
        """``window(anchor)`` gives the bounds of scores asked for; ``keep(anchor, rows, scores)`` takes the exact ones within intervals."""
        exact = x.shape[1] * max(self.most, int(np.abs(x).max(initial=0))) ** 2 < _EXACT
        held = x.astype(float) if exact else x
        points = self.anchors.astype(float) if exact else self.anchors
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        slack = 0.5 + 1e-9 * norm * (float(np.sqrt((self.anchors.astype(float) ** 2).sum(1).max(initial=0))) + 1)
        known: dict[int, list] = {}
        for a in self.order:
            p = self.parent[a]
            if p < 0:
                low, high = np.full(len(x), -np.inf), np.full(len(x), np.inf)
            else:
                reach = self.edge[a] * norm + slack
                low, high = known[p][0] - reach, known[p][1] + reach
                known[p][2] -= 1
                if not known[p][2]:
                    del known[p]
            least, most, also = window(a)
            at = np.flatnonzero((high >= least) & (low <= most) & also) if p >= 0 else np.arange(len(x))
            self.met, self.rescored = self.met + len(x), self.rescored + len(at)
            if len(at):
                s = held @ points[a] if len(at) == len(x) else held[at] @ points[a]
                low[at] = high[at] = s.astype(float)
                s = s.astype(np.int64)
                within = (s >= least) & (s <= most) & also[at]
                if within.any():
                    keep(a, at[within], s[within])
            if self.children[a]:
                known[a] = [low, high, self.children[a]]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ties go to the smaller id."""
    if len(score) > 4 * k:
        edge = np.partition(score, -k)[-k]
        some = np.flatnonzero(score >= edge)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of about ROWS rows at a time."""
    held, n = [], 0

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("id").fill_null(_NONE).to_numpy()
        vec = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        return ids, table.column("label").to_numpy(), vec

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= ROWS:
            yield joined()
            held, n = [], 0
    if n:
        yield joined()


def _positives(state, k: int):
    """(id, label, vec) to (row, vec_id, score): per anchor the task's k best rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own, labels, points, tree = state.value
        walk = Walk(points, tree)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
        floor = np.full(len(own), -np.inf)
        for ids, label, x in _blocks(batches, points.shape[1]):
            same = {v: label == v for v in np.unique(labels).tolist()}

            def window(a, same=same):
                return floor[a], np.inf, same[labels[a]]

            def keep(a, at, s, ids=ids):
                other = ids[at] != own[a]
                s, i = np.concatenate((best[a][0], s[other])), np.concatenate((best[a][1], ids[at][other]))
                some = _best(s, i, k)
                best[a] = (s[some], i[some])
                if len(some) == k:
                    floor[a] = best[a][0].min()

            walk.run(x, window, keep)
        yield _table(np.repeat(rows, [len(s) for s, _ in best]), *(np.concatenate([b[j] for b in best]) if best else np.zeros(0, np.int64) for j in (1, 0)))

    return run


def _table(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, **more) -> pa.RecordBatch:
    columns = {"row": pa.array(rows, pa.int64()), "vec_id": pa.array(ids, pa.int64(), mask=ids == _NONE), "score": pa.array(score, pa.int64())}
    return pa.RecordBatch.from_pydict(columns | {n: pa.array(c, pa.int64()) for n, c in more.items()})


def _negatives(state, k: int, low: int, high: int):
    """(id, label, vec) to (row, place, vec_id, score): per anchor and positive the task's k best negatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own, labels, points, tree, positive = state.value
        walk = Walk(points, tree)
        # whole scores s with low * p <= 100 s <= high * p
        ranges = [[(-(-low * p // 100), high * p // 100) for p in ps] for ps in positive]
        best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ps) for ps in positive]
        floor = [[float(lo) for lo, _ in r] for r in ranges]
        top = [max((float(hi) for lo, hi in r if lo <= hi), default=-np.inf) for r in ranges]
        least = [min((float(lo) for lo, hi in r if lo <= hi), default=np.inf) for r in ranges]
        for ids, label, x in _blocks(batches, points.shape[1]):
            other = {v: label != v for v in np.unique(labels).tolist()}

            def window(a, other=other):
                return least[a], top[a], other[labels[a]]

            def keep(a, at, s, ids=ids):
                for j, (lo, hi) in enumerate(ranges[a]):
                    some = np.flatnonzero((s >= max(lo, floor[a][j])) & (s <= hi) & (ids[at] != own[a]))
                    if not len(some):
                        continue
                    t, i = np.concatenate((best[a][j][0], s[some])), np.concatenate((best[a][j][1], ids[at][some]))
                    first = _best(t, i, k)
                    best[a][j] = (t[first], i[first])
                    if len(first) == k:
                        floor[a][j] = float(best[a][j][0].min())
                least[a] = min((f for f, (lo, hi) in zip(floor[a], ranges[a], strict=True) if lo <= hi), default=np.inf)

            walk.run(x, window, keep)
        found = [(rows[a], j, i, s) for a, of in enumerate(best) for j, b in enumerate(of) for s, i in zip(*b, strict=True)]
        row, place, vec_id, score = (np.array(c, dtype=np.int64) for c in (zip(*found, strict=True) if found else [[]] * 4))
        yield _table(row, vec_id, score, place=place)

    return run


def labelled(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, vec, label) of the rows that take part; labels of ids divisible by 7 move on by one, modulo 10."""
    label, seven = F.col(label_col).cast("long"), F.coalesce(F.col(id_col).cast("long") % 7 == 0, F.lit(False))
    return quantised(rows.where(F.col(label_col).isNotNull()), id_col, vector_col, F.when(seven, (label + 1) % 10).otherwise(label).alias("label"))


def mine(rows: DataFrame, anchors, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, **columns) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchors``, a column over ``id``, holds."""
    spark = rows.sparkSession
    good = cut(labelled(rows, **columns))
    asked = cut(good.where(anchors & F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id()))
    rounds = max(1, -(-asked.count() // ROUND))
    # rounds are ranges of the vectors, so that a round's anchors are near each other
    numbered = asked.withColumn("turn", F.lit(0))
    if rounds > 1:
        numbered = cut(asked.repartitionByRange(rounds, "vec", "row").withColumn("turn", F.spark_partition_id()))
        rounds = numbered.agg(F.max("turn")).first()[0] + 1
    out = None
    for t in range(rounds):
        held = numbered.where(F.col("turn") == t).orderBy("row").toArrow()  # about ROUND anchors at most
        if not held.num_rows:
            continue
        own, labels, row = (held.column(c).to_numpy() for c in ("id", "label", "row"))
        points = held.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)
        tree = spanning_tree(points.astype(float))
        state = spark.sparkContext.broadcast((row, own, labels, points, tree))
        near = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        found = good.mapInArrow(_positives(state, positives), "row long, vec_id long, score long").withColumn("place", F.row_number().over(near) - 1).where(F.col("place") < positives)
        best = cut(found.withColumn("place", F.col("place").cast("long")))
        table = best.orderBy("row", "place").toArrow()  # at most ``positives`` rows an anchor of the round
        scores = np.split(table.column("score").to_numpy(), np.searchsorted(table.column("row").to_numpy(), row, side="left")[1:])
        wide = spark.sparkContext.broadcast((row, own, labels, points, tree, [s.tolist() for s in scores]))
        each = Window.partitionBy("row", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        mined = good.mapInArrow(_negatives(wide, negatives, low, high), "row long, vec_id long, score long, place long").withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= negatives)
        ids = best.select("row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = mined.select("row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(ids, ["row", "place"]).join(numbered.select("row", F.col("id").alias("anchor_id")), "row")
        part = part.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        part = cut(part) if rounds > 1 else part
        out = part if out is None else out.unionByName(part)
        if rounds > 1:
            state.unpersist()
            wide.unpersist()
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: anchors are the rows whose vec_id is divisible by 50."""
    return mine(embeddings, F.col("id") % 50 == 0)
