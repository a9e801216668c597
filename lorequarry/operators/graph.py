"""Graph operators over edge DataFrames (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions.stats import hop_penalty
from lorequarry.operators import search as S
from lorequarry.session import cut

DAMPING, ROUNDS, TOLERANCE = 0.85, 50, 1e-10
DEPTH, NODES, FANOUT, DECAY = 2, 200, 25, 0.6
#: Rows of a node that stand for it, and weights of the two rankings that graph search fuses.
STAND, HYBRID_WEIGHT, GRAPH_WEIGHT = 2, 1.0, 0.7
#: Nodes of a level that expansion may broadcast to the edges; more of them are joined by a shuffle.
BROADCAST_NODES = 200_000


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges at a node; a self-loop counts once."""
    return _ends(edges).groupBy("node").agg(F.count("*").alias("degree"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("rid", F.col("src").alias("node")).union(edges.select("rid", F.col("dst").alias("node"))).distinct()


def _at(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows at materialised nodes; a short list is broadcast, so that the filter meets the rows before they move."""
    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    return rows.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")


def pagerank(edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, rank): weighted PageRank with dangling mass spread evenly, stopped at an L1 change below ``tolerance``.

    An iteration is a join by source and a sum per target; ranks are cut every few rounds so that plans stay short.
    """
    pairs = edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = pairs.groupBy("src").agg(F.sum("w").alias("out"))
    flows = cut(pairs.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    nodes = cut(flows.select(F.col("src").alias("node")).union(flows.select("dst")).distinct().join(out.select(F.col("src").alias("node"), F.lit(True).alias("gives")), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    rank = nodes.select("node", "gives", F.lit(1.0 / n).alias("rank"))
    for k in range(1, rounds + 1):
        loose = rank.where("gives IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        got = flows.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = nodes.join(got, "node", "left").join(F.broadcast(loose)).select("node", "gives", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))  # one row of loose mass
        if k % 5 == 0:
            new = cut(new)
            moved = new.join(rank.select("node", F.col("rank").alias("old")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved < tolerance:
                return new.select("node", "rank")
        rank = new
    return rank.select("node", "rank")


def expand(edges: DataFrame, seeds: DataFrame, depth: int = DEPTH, fanout: int = FANOUT, most: int = NODES, decay: float = DECAY, by: tuple[str, ...] = ()) -> DataFrame:
    """(node, score, depth): best score that reaches a node over at most ``depth`` hops; with ``by``, for each value of those columns of the seeds.

    Level by level: a node's ``fanout`` heaviest edges carry ``score * decay ** (hop + 1) * weight / ln(degree + e)``; a node
    keeps its best score and travels on whenever it improves; new nodes of a level are limited to the best ``most``. A level
    reads the edges again, but only those at the nodes it stands on are ranked, and only nodes that those lead to are counted.
    """
    both = edges.select("rid", F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionByName(edges.select("rid", F.col("dst").alias("node"), F.col("src").alias("other"), "weight")).where("node <> other")
    heavy = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    keys = [*by, "node"]
    fresh = Window.partitionBy(*by).orderBy(F.desc("new"), "node")
    found = cut(seeds.groupBy(*keys).agg(F.max("score").alias("score")).withColumn("depth", F.lit(0)))
    front = found
    for hop in range(depth):
        at = _at(both, cut(front.select("node").distinct()))
        heaviest = cut(at.withColumn("r", F.row_number().over(heavy)).where(F.col("r") <= fanout).select("node", "other", "weight"))
        reached = _at(_ends(edges), cut(heaviest.select(F.col("other").alias("node")).distinct())).groupBy("node").agg(F.count("*").alias("degree"))
        step = heaviest.join(reached.withColumnRenamed("node", "other"), "other").select("node", "other", (F.col("weight") * hop_penalty(F.col("degree"))).alias("factor"))
        sent = front.join(step, "node").groupBy(*by, F.col("other").alias("node")).agg(F.max(F.col("score") * decay ** (hop + 1) * F.col("factor")).alias("new"))
        met = sent.join(found.select(*keys, F.col("score").alias("old")), keys, "left").where("new > coalesce(old, 0)")
        first = met.where("old IS NULL")
        first = first.withColumn("r", F.row_number().over(fresh)).where(F.col("r") <= most) if by else first.orderBy(F.desc("new"), "node").limit(most)
        kept = met.where("old IS NOT NULL").select(*keys, F.col("new").alias("score")).unionByName(first.select(*keys, F.col("new").alias("score")))
        front = cut(kept.withColumn("depth", F.lit(hop + 1)))
        found = cut(found.join(front.select(*keys), keys, "left_anti").unionByName(front))
    return found


def upsert(rows: DataFrame) -> DataFrame:
    """One row per id: largest weight and confidence, first summary that is not null by order of arrival."""
    summary = F.min_by("summary", F.when(F.col("summary").isNotNull(), F.col("seq")))
    return rows.groupBy("id").agg(F.max("weight").alias("weight"), F.max("confidence").alias("confidence"), summary.alias("summary"))


def stand_ins(mentions: DataFrame, most: int = STAND) -> DataFrame:
    """(node, doc_id): the ``most`` heaviest documents of each node of mentions (node, doc_id, weight); ties go to the smaller id."""
    w = Window.partitionBy("node").orderBy(F.desc("weight"), "doc_id")
    return mentions.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("node", "doc_id")


def search(base: DataFrame, mentions: DataFrame, edges: DataFrame, seeds: int, more: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, matched_by): a ranking and what a graph reaches from its first hits, fused.

    ``base`` is (query_id, doc_id, rank). Nodes that the first ``seeds`` hits mention start the expansion at 1 / rank; nodes that
    it reaches are stood in for by documents, of ``mentions`` and ``more``, ranked by the best score of their nodes. Both rankings are fused by reciprocal
    ranks at the weights 1.0 and 0.7. A hit without a node, and a node without documents, add nothing; no hits give no rows.
    """
    hits = base.select("query_id", "doc_id", "rank")
    start = hits.where(F.col("rank") <= seeds).join(mentions.select("node", "doc_id"), "doc_id").select("query_id", "node", (1.0 / F.col("rank")).alias("score"))
    reached = expand(edges, start, by=("query_id",)).where("depth > 0")
    found = reached.join(stand_ins(mentions if more is None else mentions.unionByName(more)), "node").groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    graph = found.select("query_id", "doc_id", F.row_number().over(w).alias("rank"), F.lit("graph").alias("source"))
    return S.rrf(hits.withColumn("source", F.lit("hybrid")).unionByName(graph), {"hybrid": HYBRID_WEIGHT, "graph": GRAPH_WEIGHT})
