"""Dependency graphs over edges (src requires dst): closure, order, and the cycle that a new edge would close.

Each works by rounds of joins over what is new since the round before, cut in the checkpoint folder; a round count is at most
the longest path, and its logarithm for the closure of graphs that do not fan out. Nulls at either end are no edges; repeated edges count once; a self-loop is a cycle of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.session import cut

#: Rows that a round of the closure may meet, as a multiple of the pairs known.
WIDE = 4


def _clean(edges: DataFrame) -> DataFrame:
    return cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): everything that src requires, directly or not, with the least number of steps.

    With all pairs of up to n steps known, those of n + 1 to 2 n steps are a pair of just n steps and a known one behind it, so
    rounds grow with the logarithm of the longest path and known pairs move once a round. Where paths fan out so much that
    this would meet more than WIDE times the known pairs, a round goes one edge further instead.
    """
    edges = _clean(edges).withColumn("depth", F.lit(1))
    known = front = edges
    depth, rounds, pairs = 1, 0, edges.count()
    while not front.isEmpty():
        step, far = edges, 1
        if depth > 1 and _meetings(front, known) <= WIDE * pairs:
            step, far = known, depth
        behind = step.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("depth").alias("more"))
        reached = front.join(behind, "dst").groupBy("src", F.col("next").alias("dst")).agg((F.min("more") + depth).cast("int").alias("depth"))
        new, depth = cut(reached.join(known.select("src", "dst"), ["src", "dst"], "left_anti")), depth + far
        known, pairs = known.unionByName(new), pairs + new.count()
        front = new.where(F.col("depth") == depth)
        rounds += 1
        if rounds % 8 == 0:
            known = cut(known)
    return known


def _meetings(front: DataFrame, known: DataFrame) -> int:
    """How many rows the join of pairs with those behind them has."""
    before, after = front.groupBy("dst").agg(F.count("*").alias("a")), known.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("b"))
    return before.join(after, "dst").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 for what requires nothing, else one more than the highest level required; null on and behind a cycle.

    Kahn's rounds: a node is settled when the last edge that it waits for is; only edges at newly settled nodes are looked at.
    """
    edges = _clean(edges)
    every = cut(nodes.select("node").where("node IS NOT NULL").union(edges.select("src")).union(edges.select("dst")).distinct())
    waits = edges.groupBy("src").agg(F.count("*").alias("of"))
    new = cut(every.join(waits, every["node"] == waits["src"], "left_anti"))
    settled, met, level = new.withColumn("level", F.lit(0)), None, 0
    while True:
        level += 1
        freed = edges.join(new.select(F.col("node").alias("dst")), "dst").groupBy("src").agg(F.count("*").alias("n"))
        met = freed if met is None else met.unionByName(freed).groupBy("src").agg(F.sum("n").alias("n"))
        met = cut(met.join(waits, "src"))
        new = cut(met.where("n = of").select(F.col("src").alias("node")))
        if met.isEmpty() or new.isEmpty():
            return every.join(settled, "node", "left")
        met = met.where("n < of").select("src", "n")
        settled = settled.unionByName(new.withColumn("level", F.lit(level)))
        if level % 8 == 0:
            settled = cut(settled)


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in a total order, by ranges: no task sorts more than its range, and only the ranges' sizes are gathered."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn(name, place).join(F.broadcast(sizes.select("__range", "before")), "__range").withColumn(name, (F.col(name) + F.col("before")).cast("long")).drop("__range", "before")


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, place): what is required comes first, ties in the order of the nodes; nodes on or behind a cycle are left out."""
    return numbered(levels(nodes, edges).where("level IS NOT NULL"), "level", "node")


def closed_cycles(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(src, dst, path): the cycle src, dst, ..., src that inserting each candidate edge would close, or null.

    A breadth-first search per candidate from dst towards src, all at once; of the shortest paths the least in node order.
    """
    edges = _clean(edges)
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    asked = cut(candidates.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    front = asked.select("src", "dst", F.col("dst").alias("node"), F.array("src", "dst").alias("path"))
    found = front.where("src = dst").select("src", "dst", F.array("src", "dst").alias("path"))
    front = cut(front.where("src <> dst"))
    seen, rounds = front.select("src", "dst", "node"), 0
    while not front.isEmpty():
        rounds += 1
        on = front.join(step, "node").select("src", "dst", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"))
        least = cut(on.groupBy("src", "dst", "node").agg(F.min("path").alias("path")))
        closed = least.where("node = src").select("src", "dst", "path")
        found = cut(found.unionByName(closed))
        front = cut(least.join(seen, ["src", "dst", "node"], "left_anti").join(closed.select("src", "dst"), ["src", "dst"], "left_anti"))
        seen = seen.unionByName(front.select("src", "dst", "node"))
        if rounds % 8 == 0:
            seen = cut(seen)
    return asked.join(found, ["src", "dst"], "left")
