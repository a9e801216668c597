import math
import random

import numpy as np
import pytest

from lorequarry.llm import hardneg as h


def brute(rows, k=5, m=3):
    good = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((math.inf if i is None else i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    sizes = [len(v) for _, v, _ in good]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    good = [g for g in good if len(g[1]) == size]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    back = lambda i: None if i == math.inf else i
    out = []
    for i, q, label in good:
        if i == math.inf or i % 50:
            continue
        scored = sorted((-dot(q, v), j, of) for j, v, of in good if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:k]:
            p = -s
            hits = [x for x in scored if x[2] != label and 50 * p <= -100 * x[0] <= 95 * p][:m]
            out += [(i, back(j), r + 1, back(n), p, -t) for r, (t, n, _) in enumerate(hits)]
    return sorted(out, key=str)


def hold(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = h.digest(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    return got


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 2), (50, [0.0, 0.0], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [1.0], 1), (None, [0.9, 0.1], 2), (6, [0.4, 0.1], None), (100, [-1.0, 1.0], 1)]
    rows += [(k, [0.25 + k / 100, 0.25], k % 3) for k in range(8, 40)] + [(41, [0.3, 0.25], 1)] * 3
    assert hold(spark, rows)
    hold(spark, rows[:1])
    assert h.digest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("size", [5, 4096])
def test_clusters_in_several_rounds_and_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(h, "ROUND", size)
    monkeypatch.setattr(h, "ROWS", 64)
    rng = random.Random(size)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.randrange(3)) for i in range(700)]
    assert len(hold(spark, rows)) > 50


def test_tree_spans_and_bounds_prune_clusters():
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([c + rng.normal(0, 2, (200, 8)) for c in rng.normal(0, 300, (6, 8))])).astype(np.int64)
    anchors = x[::20]
    order, parent, edge = h.spanning_tree(anchors.astype(float))
    assert sorted(order) == list(range(len(anchors))) and parent[0] == -1 and sum(parent < 0) == 1
    walk, found = h.Walk(anchors, (order, parent, edge)), {}
    best = [int((x @ a).max()) for a in anchors]
    walk.run(x, lambda a: (best[a] - 100, np.inf, np.ones(len(x), bool)), lambda a, at, s: found.__setitem__(a, set(at.tolist())))
    for a in range(len(anchors)):
        assert found[a] == set(np.flatnonzero(x @ anchors[a] >= best[a] - 100).tolist())
    assert walk.rescored < 0.4 * walk.met
