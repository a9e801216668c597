import math
import random

import pytest

from lorequarry.llm import topk as t


def brute(rows, k=5, every=50):
    good = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v]))
    sizes = [len(v) for _, v in good]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    good = [g for g in good if len(g[1]) == size]
    out = []
    for i, q in good:
        if i is None or i % every:
            continue
        best = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), math.inf if j is None else j) for j, v in good if j != i))[:k]
        out += [(i, r + 1, None if j is math.inf else j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=str)


def hold(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = t.top_k(df, t.F.col("id") % 50 == 0, **more).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.5]), (0, [0.5, -0.5]), (50, [0.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0]), (None, [0.9, 0.1]), (6, [0.9, 0.1]), (100, [1.0, 1.0])] + [(k, [0.25, 0.25]) for k in range(7, 20)]
    hold(spark, rows)
    hold(spark, rows[:1])
    assert t.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("pivots", [2, 16])
def test_clusters_ties_and_small_blocks(spark, monkeypatch, pivots):
    monkeypatch.setattr(t, "BLOCK", 400)
    monkeypatch.setattr(t, "GROUP_QUERIES", 6)
    rng = random.Random(pivots)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(600)] + [(600 + i, centres[0]) for i in range(300)]
    hold(spark, rows, pivots=pivots)


@pytest.mark.parametrize("copies", [2, 10])
def test_a_lone_query_whose_id_repeats(spark, monkeypatch, copies):
    monkeypatch.setattr(t, "BLOCK", 40)
    rng = random.Random(copies)
    # copies are the longest rows and lie at a pivot of their own; all others have ids that are never asked
    rows = [(50, [4.0, 4.0])] * copies + [(50 * k + 1, [rng.gauss(0, 1), rng.gauss(0, 1)]) for k in range(1, 120)]
    hold(spark, rows)
    hold(spark, rows, pivots=500)


def test_rows_of_one_id_are_dealt_to_all_blocks():
    import numpy as np
    import pyarrow as pa

    n = 600
    batch = pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array([[1, 2]] * n), pa.array([0] * n, pa.int32()), pa.array([1.0] * n)], ["id", "vec", "cell", "d"])
    sent = [b for out in t._replicate(np.array([[0.0]]), np.array([0]), 3)([batch]) for b in out.column(1).to_pylist()]
    assert sorted(map(sent.count, range(3))) == [200, 200, 200]


def test_no_worker_takes_more_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 100)
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(2000)], "vec_id long, embedding array<double>").repartition(3)
    met, sent, _ = t.dealt(rows, t.F.col("id") % 50 == 0, 5, "vec_id", "embedding", None)
    assert met.select("block").distinct().count() == math.ceil(2000 / 100)
    largest = sent.groupBy("grp", "block").count().agg(t.F.max("count")).first()[0]
    assert 0 < largest <= 110
