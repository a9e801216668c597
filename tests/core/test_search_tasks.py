"""What tasks of keyword search hand on: the best of each query."""

import random

import pyarrow as pa
import pytest

from lorequarry.operators import search as S


def corpus(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)] + ["Ärger", "x2"]
    rows = [(k // 2 if k % 9 == 0 else k, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for k in range(120)] + [(None, "w1 w2"), (None, "w1"), (500, None), (501, " ")]
    asked = [(q, " ".join(rng.sample(words, 6))) for q in range(8)] + [(99, "nowhere"), (100, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), S.query_terms(spark.createDataFrame(asked, "query_id long, text string"))


@pytest.mark.parametrize("prefix", [False, True])
def test_scores_in_tasks_are_those_of_the_joins(spark, prefix):
    docs, terms = corpus(spark)
    want = {(r.query_id, r.doc_id): r.score for r in S._joined(docs, terms, prefix).collect()}
    got = {(r.query_id, r.doc_id): r.score for r in S.bm25(docs, terms, prefix).collect()}
    assert got.keys() == want.keys() and len(got) > 300
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    best = S.bm25(docs, terms, prefix, most=4)
    assert best.count() <= 4 * 8 * best.rdd.getNumPartitions()
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in S.ranked(df.where("doc_id IS NOT NULL"), 3).collect())
    assert rows(best) == rows(S.bm25(docs, terms, prefix))
    assert S.bm25(docs.limit(0), terms).count() == 0 and S.bm25(docs, terms.limit(0)).count() == 0


def test_tiles_hold_whole_documents(monkeypatch):
    monkeypatch.setattr(S, "POSTINGS", 4)
    doc = [None, None, 1, 1, 1, 2, 2, 2, 2, 2, 3, 4]
    table = pa.table({"doc_id": pa.array(doc, pa.int64()), "dl": [3] * 12, "term": pa.array([0, 1, 0, 1, 2, 0, 1, 2, 0, 1, 2, 0], pa.int32()), "tf": [1.0] * 12})
    step = S._summed(S.np.array([1.0, 2.0, 4.0]), 3.0, S.np.array([0, 1, 2, 3]), S.np.zeros(3, dtype=int), pa.array([7]), None)
    got = [(d, s) for b in step(iter(table.to_batches(max_chunksize=3))) for d, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert got == [(None, 3.0), (1, 7.0), (2, 10.0), (3, 4.0), (4, 1.0)]
