"""Connected components by alternating large and small stars, in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import cut_narrow


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, cut, and what tells two rounds apart: their number and a sum of hashes, observed as they are written."""
    return cut_narrow(edges, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; the root is the least node that it reaches. Empty edges: no rows.

    A star is a minimum per node joined back to its edges, so a hub with a third of all edges is pre-aggregated and its
    join can be split; no neighbourhood is ever gathered. Each round is cut in the checkpoint folder.
    """
    now, state = _counted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # repeats go with the distinct below
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before = state
        now, state = _counted(small)
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
