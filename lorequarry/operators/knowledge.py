"""A graph of what documents define and mention, kept up to date document by document.

An extractor turns documents into entities (id, name, document_id) and mentions (document_id, src, name). Edges lead from a
mention's source to every entity of that name in another document; a name that more than ``HOMONYMS`` entities bear is
ambiguous and leads nowhere, so a common word makes no edges of all with all. ``update`` rewrites only what is born in touched documents
and falls back to a full build where a change is not local: too many documents, a manifest among them, documents that are new
or gone, no graph yet, or another set of entities, since edges of other documents hang on the names that exist. Rows of other
layers than ``derived`` are never touched. Null names are no entities and no mentions; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.session import cut

#: Touched documents up to which an update is local.
MOST = 50
HOMONYMS = 4
#: Entities with a clear name that may be broadcast to the mentions; more of them are joined by a shuffle.
BROADCAST_NAMES = 200_000
LAYER = "derived"
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass
class Graph:
    """Entities (id, name, document_id, layer) and edges (src, dst, document_id, layer); ``reason`` says why a build was full."""

    entities: DataFrame
    edges: DataFrame
    reason: str | None = None


def _linked(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    clear = entities.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= HOMONYMS).select("name")
    named = cut(entities.join(clear, "name", "left_semi").select(F.col("id").alias("dst"), "name", F.col("document_id").alias("of")))
    # most mentions name no entity: they meet the names before they move, and what is left is made distinct
    few = named.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    met = mentions.select("document_id", "src", "name").join(F.broadcast(named) if few else named, "name").where(F.col("of") != F.col("document_id"))
    # the layer is added behind the cut: edges are the most that is written
    return cut(met.select("src", "dst", "document_id").distinct()).withColumn("layer", F.lit(LAYER))


def _entities(rows: DataFrame) -> DataFrame:
    return rows.where("name IS NOT NULL").select("id", "name", "document_id", F.lit(LAYER).alias("layer")).distinct()


def build(docs: DataFrame, extract: Extractor, other: Graph | None = None, reason: str | None = None) -> Graph:
    """The whole graph; rows of other layers of ``other`` stay, edges only while both ends exist."""
    found, mentions = extract(docs)
    entities = cut(_entities(found))
    edges = _linked(mentions, entities)
    if other is not None:
        kept = other.entities.where(F.col("layer") != LAYER)
        entities = cut(entities.unionByName(kept.join(entities.select("id"), "id", "left_anti")))
        foreign = other.edges.where(F.col("layer") != LAYER)
        ends = entities.select("id")
        foreign = foreign.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
        edges = edges.unionByName(cut(foreign.select(*edges.columns)))
    return Graph(entities, edges, reason)


def update(graph: Graph, docs: DataFrame, touched: DataFrame, extract: Extractor, most: int = MOST, manifest: Column | None = None) -> Graph:
    """The graph after the documents (doc_id) of ``touched`` changed; ``docs`` is what is there now.

    A local update writes the new edges alone and filters the others where they lie, so a long series of updates wants a cut now and then.
    """
    ids = cut(touched.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct())
    n = ids.count()
    if not n:
        return graph
    if n > most:
        return build(docs, extract, graph, f"{n} documents, more than {most}")
    now = cut(docs.join(F.broadcast(ids), "doc_id", "left_semi"))  # at most ``most`` ids
    if manifest is not None and not now.where(manifest).isEmpty():
        return build(docs, extract, graph, "a manifest")
    mine = graph.entities.where(F.col("layer") == LAYER)
    if mine.isEmpty():
        return build(docs, extract, graph, "no graph yet")
    before = cut(mine.join(F.broadcast(ids.withColumnRenamed("doc_id", "document_id")), "document_id", "left_semi").select("id", "name", "document_id", "layer"))
    if now.select("doc_id").distinct().count() != n:
        return build(docs, extract, graph, "documents that are gone")
    found, mentions = extract(now)
    after = cut(_entities(found))
    key = ["id", "name", "document_id"]
    changed = before.select(key).exceptAll(after.select(key)).unionByName(after.select(key).exceptAll(before.select(key)))
    if not changed.isEmpty():
        return build(docs, extract, graph, "another set of entities")
    born = F.broadcast(ids.withColumnRenamed("doc_id", "document_id"))
    kept = graph.edges.where(F.col("layer") != LAYER).unionByName(graph.edges.where(F.col("layer") == LAYER).join(born, "document_id", "left_anti").select(*graph.edges.columns))
    return Graph(graph.entities, kept.unionByName(_linked(mentions, mine).select(*graph.edges.columns)), None)


def titles_and_words(words: Callable[[Column], Column]) -> Extractor:
    """Documents define their first word and mention all others: for corpora of prose."""

    def extract(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        held = docs.select(F.col("doc_id").cast("long").alias("document_id"), words(F.coalesce("text", F.lit(""))).alias("w"))
        own = F.concat(F.lit("d"), F.col("document_id"))
        entities = held.select(own.alias("id"), F.try_element_at("w", F.lit(1)).alias("name"), "document_id")
        mentions = held.select("document_id", own.alias("src"), F.explode(F.array_distinct("w")).alias("name"))
        return entities, mentions

    return extract
