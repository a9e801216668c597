import random

from lorequarry.functions import text as T
from lorequarry.operators import knowledge as k

EXTRACT = k.titles_and_words(T.words)


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def rows(graph):
    return sorted(map(tuple, graph.entities.collect())), sorted(map(tuple, graph.edges.collect()))


def ids(spark, *some):
    return spark.createDataFrame([(i,) for i in some], "doc_id long")


def test_updates_equal_a_full_build(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)]
    docs = {i: " ".join(rng.choices(words, k=6)) for i in range(30)}
    graph = k.build(frame(spark, docs), EXTRACT)
    for step in range(4):
        some = rng.sample(sorted(docs), 4)
        for i in some:
            first = docs[i].split()[0] if step != 2 else rng.choice(words)
            docs[i] = " ".join([first, *rng.choices(words, k=5)])
        graph = k.update(graph, frame(spark, docs), ids(spark, *some, None), EXTRACT)
        assert rows(graph) == rows(k.build(frame(spark, docs), EXTRACT))
        assert graph.reason == ("another set of entities" if step == 2 else None)


def test_when_a_change_is_not_local(spark):
    docs = {i: f"a{i} a{(i + 1) % 9} x" for i in range(9)}
    df = frame(spark, docs)
    graph = k.build(df, EXTRACT)
    note = spark.createDataFrame([("d1", "d2", 1, "semantic"), ("d1", "gone", 1, "semantic")], "src string, dst string, document_id long, layer string")
    graph = k.Graph(graph.entities, graph.edges.unionByName(note))
    assert k.update(graph, df, ids(spark), EXTRACT) is graph
    assert k.update(graph, df, ids(spark, 1), EXTRACT).edges.where("layer = 'semantic'").count() == 2
    full = k.update(graph, df, ids(spark, 1, 2, 3), EXTRACT, most=2)
    assert full.reason == "3 documents, more than 2" and full.edges.where("layer = 'semantic'").count() == 1
    assert k.update(graph, df, ids(spark, 1), EXTRACT, manifest=k.F.col("doc_id") == 1).reason == "a manifest"
    assert k.update(graph, df.where("doc_id <> 1"), ids(spark, 1), EXTRACT).reason == "documents that are gone"
    assert k.update(graph, frame(spark, docs | {40: "new x"}), ids(spark, 40), EXTRACT).reason == "another set of entities"
    assert k.update(k.Graph(graph.entities.limit(0), graph.edges.limit(0)), df, ids(spark, 1), EXTRACT).reason == "no graph yet"


def test_mentions_meet_clear_names_before_they_move(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 40} and w{i % 7} the w{i % 7} w{(i * 3) % 40}") for i in range(120)], "doc_id long, text string")
    found, mentions = k.titles_and_words(T.words)(docs)
    mentions = mentions.unionByName(mentions)  # repeated rows count once
    entities = k._entities(found)
    joins, real = [], k.F.broadcast
    monkeypatch.setattr(k.F, "broadcast", lambda df: joins.append(df) or real(df))
    edges = k._linked(mentions, entities)
    assert len(joins) == 1
    want = sorted(map(tuple, edges.collect()))
    assert want and len(set(want)) == len(want)
    monkeypatch.setattr(k, "BROADCAST_NAMES", 0)
    assert sorted(map(tuple, k._linked(mentions, entities).collect())) == want
