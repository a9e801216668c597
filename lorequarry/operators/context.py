"""Context assembly per query: duplicates, diversity and a token budget. Groups hold one query's candidates, a few hundred at most."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR, LAMBDA, RESERVE, MARGIN, SOURCES = 0.93, 0.7, 0.05, 0.03, 3


def literal_dedup(hits: DataFrame, hash_col: str = "hash") -> DataFrame:
    """Adds ``kept`` and the document that a dropped hit repeats; the best ranked of equal contents stays."""
    w = Window.partitionBy("query_id", hash_col).orderBy("rank")
    return hits.withColumn("kept", F.row_number().over(w) == 1).withColumn("repeats", F.when(~F.col("kept"), F.first("doc_id").over(w)))


def near_places(vectors: list, threshold: float = NEAR) -> list[bool]:
    """In order of rank: whether each vector is kept; one close to a kept vector goes, one that is missing stays."""
    kept, out = [], []
    for v in vectors:
        if v is None:
            out.append(True)
            continue
        close = bool(kept) and float(np.max(np.stack(kept) @ v)) >= threshold
        out.append(not close)
        if not close:
            kept.append(v)
    return out


def mmr_order(vectors: list, scores: list[float], query, k: int, weight: float = LAMBDA) -> list[int]:
    """Places in the order in which relevance less redundancy picks them; ties go to the first.

    All similarities come from one Gram matrix of the hits that have a vector. A hit without one is as relevant as its
    score and redundant to nothing, and makes nothing redundant.
    """
    known = [i for i, v in enumerate(vectors) if v is not None]
    gram, merit = np.zeros((len(vectors), len(vectors))), weight * np.array(scores, dtype=float)
    if known:
        held = np.array([vectors[i] for i in known], dtype=float)
        gram[np.ix_(known, known)] = held @ held.T
        merit[known] = weight * (held @ query)
    order: list[int] = []
    rest = list(range(len(vectors)))
    while rest and len(order) < k:
        against = [i for i in order if vectors[i] is not None]
        worth = merit[rest] - (1 - weight) * (gram[np.ix_(rest, against)].max(axis=1) if against else 0.0)
        order.append(rest.pop(int(worth.argmax())))
    return order


def budget_choice(docs: list, tokens: list[int], scores: list[float], budget: int, overhead: int = 0) -> list[int]:
    """Indices chosen: the best hit of each of the first three documents, then by score per token, while the budget lasts."""
    usable, used, chosen = int(budget * (1 - RESERVE - MARGIN)), 0, []
    firsts = {d: i for i, d in reversed(list(enumerate(docs)))}.values()
    reserved = sorted(firsts)[:SOURCES]
    rest = sorted((i for i in range(len(docs)) if i not in reserved), key=lambda i: -scores[i] / max(tokens[i], 1))
    for i in [*reserved, *rest]:
        cost = tokens[i] + overhead
        if used + cost <= usable:
            chosen.append(i)
            used += cost
    return sorted(chosen)


def assemble(hits: DataFrame, queries: DataFrame, budget: int, k: int = 20) -> DataFrame:
    """(query_id, doc_id, place, tokens) of hits (query_id, doc_id, source, rank, score, tokens, vector) and queries (query_id, query)."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "doc_id"]).reset_index(drop=True)
        vectors = [None if v is None else np.array(v, dtype=float) for v in part["vector"]]
        part = part[near_places(vectors)].reset_index(drop=True)
        vectors = [None if v is None else np.array(v, dtype=float) for v in part["vector"]]
        order = mmr_order(vectors, part["score"].tolist(), np.array(part["query"].iloc[0], dtype=float), k)
        part = part.iloc[order].reset_index(drop=True)
        part = part.iloc[budget_choice(part["source"].tolist(), part["tokens"].tolist(), part["score"].tolist(), budget)]
        return pd.DataFrame({"query_id": part["query_id"], "doc_id": part["doc_id"], "place": range(1, len(part) + 1), "tokens": part["tokens"]})

    return hits.join(queries, "query_id").groupBy("query_id").applyInPandas(one, "query_id long, doc_id long, place int, tokens long")


def hard_cap(fragments: DataFrame, budget: int, footer: int = 0) -> DataFrame:
    """Fragments (query_id, place, tokens, header) whose rendering stays within a budget; adds ``used`` and ``shortened``.

    A fragment costs its tokens and those of its header, and the footer is paid once. The last fragments go until the rest
    fits, so the longest fitting run of places stays; where not even the first fits, it stays alone, shortened to what
    the budget leaves. A budget that does not hold the first header and the footer leaves nothing; null tokens count as none.
    """
    w = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    tokens, header = F.coalesce("tokens", F.lit(0)), F.coalesce("header", F.lit(0))
    run = fragments.withColumn("used", F.sum(tokens + header).over(w) + footer)
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("place")) == 1
    alone = first & (F.col("used") > budget) & (header + footer < budget)
    run = run.withColumn("shortened", alone).where((F.col("used") <= budget) | F.col("shortened"))
    return run.withColumn("tokens", F.when(F.col("shortened"), budget - footer - header).otherwise(tokens)).withColumn("used", F.least("used", F.lit(budget)))
