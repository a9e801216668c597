import random
from collections import deque

from lorequarry.operators import dag


def graph(seed, n=40, m=70, acyclic=True):
    rng = random.Random(seed)
    edges = set()
    while len(edges) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if not acyclic or a > b:
            edges.add((a, b))
    return sorted(edges)


def paths_from(edges, start):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    seen, todo = {}, deque([(start, 0)])
    while todo:
        v, d = todo.popleft()
        for w in out.get(v, []):
            if w not in seen:
                seen[w] = d + 1
                todo.append((w, d + 1))
    return seen


def frame(spark, edges):
    return spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long")


def test_closure_has_least_depths(spark):
    for acyclic in (True, False):
        edges = graph(1, acyclic=acyclic)
        want = {(a, b, d) for a in {x for x, _ in edges} for b, d in paths_from(edges, a).items()}
        assert set(map(tuple, dag.closure(frame(spark, edges)).collect())) == want
    assert dag.closure(frame(spark, [])).count() == 0


def test_levels_order_and_cycles(spark):
    edges = graph(2)
    nodes = spark.createDataFrame([(k,) for k in [*range(45), None, 3]], "node long")
    of = {}

    def level(v):
        if v not in of:
            of[v] = max((level(b) + 1 for a, b in edges if a == v), default=0)
        return of[v]

    got = {r.node: r.level for r in dag.levels(nodes, frame(spark, edges)).collect()}
    assert got == {v: level(v) for v in range(45)}
    order = dag.topological(nodes, frame(spark, edges)).collect()
    assert [r.node for r in sorted(order, key=lambda r: r.place)] == sorted(range(45), key=lambda v: (level(v), v)) and sorted(r.place for r in order) == list(range(1, 46))
    bad = [(1, 2), (2, 3), (3, 1), (4, 1), (2, 0), (9, 9)]
    assert {r.node: r.level for r in dag.levels(nodes.where("node < 1"), frame(spark, bad)).collect()} == {0: 0, 1: None, 2: None, 3: None, 4: None, 9: None}


def test_a_new_edge_closes_the_shortest_and_least_cycle(spark):
    edges = graph(3)
    rng = random.Random(4)
    asked = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(5, 5)})
    got = {(r.src, r.dst): r.path for r in dag.closed_cycles(frame(spark, edges), frame(spark, asked)).collect()}
    assert set(got) == set(asked)
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    for s, d in asked:
        front, best = [[s, d]], [s, d] if s == d else None
        while front and best is None:
            ends = sorted(p for p in front if p[-1] == s and len(p) > 2)
            best = ends[0] if ends else None
            front = [[*p, w] for p in front for w in out.get(p[-1], [])] if len(front[0]) < 45 and len(front) < 20_000 else []
        assert got[s, d] == best


def test_closure_doubles_and_does_not_meet_too_many(spark, monkeypatch):
    chain = [(k + 1, k) for k in range(40)] + [(k + 2, k) for k in range(0, 30, 3)] + [(100, 101), (101, 102), (102, 100)]
    rounds, real = [], dag.cut
    monkeypatch.setattr(dag, "cut", lambda df: rounds.append(1) or real(df))
    want = {(a, b, d) for a in {x for x, _ in chain} for b, d in paths_from(chain, a).items()}
    assert set(map(tuple, dag.closure(frame(spark, chain)).collect())) == want
    assert len(rounds) <= 8
    wide = [(0, k) for k in range(1, 21)] + [(a, b) for a in range(1, 21) for b in range(21, 41)] + [(b, c) for b in range(21, 41) for c in range(41, 61)] + [(c, 61) for c in range(41, 61)] + [(61, 62), (62, 0)]
    for limit in (4, 0):
        monkeypatch.setattr(dag, "WIDE", limit)
        want = {(a, b, d) for a in {x for x, _ in wide} for b, d in paths_from(wide, a).items()}
        assert set(map(tuple, dag.closure(frame(spark, wide)).collect())) == want
