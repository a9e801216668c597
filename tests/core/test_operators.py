import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.operators import chunking, context, embedding, graph, security, tasks
from lorequarry.operators import search as S
from lorequarry.sources import files


def plain_rank(edges, damping=0.85):
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    out = {n: sum(w for a, _, w in edges if a == n) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(50):
        loose = sum(rank[n] for n in nodes if not out[n])
        rank = {n: (1 - damping) / len(nodes) + damping * (sum(rank[a] * w / out[a] for a, b, w in edges if b == n) + loose / len(nodes)) for n in nodes}
    return rank


def test_pagerank_equals_a_plain_loop(spark):
    edges = [(1, 2, 1.0), (2, 3, 2.0), (3, 1, 1.0), (1, 3, 0.5), (4, 1, 1.0), (3, 5, 1.0)]
    got = {r.node: r.rank for r in graph.pagerank(spark.createDataFrame(edges, "src long, dst long, weight double"), rounds=50).collect()}
    want = plain_rank(edges)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], abs=1e-6) for n in want)


def test_expand_scores_and_depths(spark):
    edges = [("a", 1, 2, 1.0), ("b", 2, 3, 1.0), ("c", 1, 3, 0.1)]
    out = {r.node: (r.score, r.depth) for r in graph.expand(spark.createDataFrame(edges, "rid string, src long, dst long, weight double"), spark.createDataFrame([(1, 1.0)], "node long, score double")).collect()}
    penalty = 1 / np.log(2 + np.e)
    first = 0.6 * penalty
    assert out[1] == (1.0, 0) and out[2][0] == pytest.approx(first)
    assert out[3][0] == pytest.approx(max(0.6 * 0.1 * penalty, first * 0.36 * penalty)) and out[3][1] == 2


def test_degrees_count_a_loop_once(spark):
    edges = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "rid string, src long, dst long")
    assert {r.node: r.degree for r in graph.degrees(edges).collect()} == {1: 2, 2: 1}


def slow_mmr(vectors, scores, query, k, weight=0.7):
    chosen = []
    while len(chosen) < min(k, len(vectors)):
        best, at = None, None
        for i, v in enumerate(vectors):
            if i in chosen:
                continue
            near = max((float(v @ vectors[j]) for j in chosen if vectors[j] is not None), default=0.0) if v is not None else 0.0
            value = weight * (float(v @ query) if v is not None else scores[i]) - (1 - weight) * near
            if best is None or value > best + 1e-12:
                best, at = value, i
        chosen.append(at)
    return chosen


@pytest.mark.parametrize("seed", range(60))
def test_mmr_equals_the_double_loop(seed):
    rng = np.random.default_rng(seed)
    vectors = [None if rng.random() < 0.2 else (lambda x: x / np.linalg.norm(x))(rng.normal(size=16)) for _ in range(12)]
    scores, query = rng.random(12).tolist(), rng.normal(size=16)
    if any(v is not None for v in vectors):
        assert context.mmr_order(vectors, scores, query, 8) == slow_mmr(vectors, scores, query, 8)


def test_near_duplicates_and_budget():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert context.near_places([a, a, b, None, np.array([0.99, 0.14])]) == [True, False, True, True, False]
    chosen = context.budget_choice(["x", "x", "y", "z", "w"], [10, 10, 10, 10, 10], [5.0, 4.0, 3.0, 2.0, 1.0], 44)
    assert chosen == [0, 1, 2, 3]
    assert context.budget_choice(["x"], [100], [1.0], 50) == []


def test_context_pack_within_budget(spark):
    from lorequarry.plans import registry

    used = registry.QUERIES["context_pack"](spark, "/root/testdata/sf0.001").groupBy("query_id").agg(F.sum("tokens").alias("t")).collect()
    assert used and all(r.t <= 3000 * 0.92 for r in used)


def test_cron(spark):
    from datetime import datetime

    cases = (("*/15 * * * *", "2024-01-01 00:07:30", "2024-01-01 00:15:00"), ("0 9 * * 1", "2024-01-01 09:00:00", "2024-01-08 09:00:00"), ("30 23 31 12 *", "2024-02-01 00:00:00", "2024-12-31 23:30:00"), ("5,10 1-2/1 * * *", "2024-01-01 01:09:00", "2024-01-01 01:10:00"))
    for cron, after, want in cases:
        got = spark.range(1).select(tasks.cron_next(cron, F.lit(after).cast("timestamp")).cast("string").alias("x")).first().x
        assert got == want
    assert spark.range(1).select(tasks.cron_next("0 0 30 2 *", F.lit(datetime(2024, 1, 1)))).first()[0] is None
    for bad in ("* * * *", "61 * * * *", "a * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            tasks.cron_fields(bad)


def test_security_gate(spark):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefghijkmnpqrstuvwxyz23456789") for _ in range(36))
    rows = [(1, f"x\ntoken ghp_{body} here"), (2, f'secret_key = "{body[:24]}"\nagain secret_key = "{body[:24]}"'), (3, "password = changeme\napi_key = your-api-key-here"), (4, None), (5, "password: " + "a" * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = security.findings(docs)
    assert {(r.doc_id, r.rule, r.line) for r in found.collect()} == {(1, "github-token", 2), (2, "generic-secret-assignment", 1)}
    assert {(r.doc_id, r.verdict) for r in security.verdicts(found).collect()} == {(1, "block"), (2, "redact")}
    assert {r.verdict for r in security.verdicts(found, "strict").collect()} == {"block"}
    clean = {r.doc_id: r.text for r in security.redacted(docs, found).collect()}
    assert all(body[:24] not in t for t in clean.values()) and clean[2].count("\n") == 1


def test_diversify_moves_and_drops_nothing(spark):
    hits = spark.createDataFrame([(1, "d", k) for k in range(1, 6)] + [(1, "e", 6)], "query_id long, doc string, rank int")
    out = {r.rank: r.place for r in S.diversify(hits, "doc").collect()}
    assert out == {1: 1, 2: 2, 3: 3, 6: 4, 4: 5, 5: 6}


def test_two_stage_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = rows.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = S.vector_top(rows, asked, 10).select("query_id", "vec_id")
    assert S.two_stage(rows, asked, 10).join(exact, ["query_id", "vec_id"], "left_semi").count() >= 180


def test_page_chunks(spark):
    html = "<html><title>T</title><h1>A</h1><p>one</p><p>two</p><h2>B</h2><p>" + "word " * 1200 + "</p><script>no</script></html>"
    out = chunking.page_chunks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), 512, 24).collect()
    assert [r.heading_path for r in out][:2] == ["A", "A › B"] and out[0].content == "one\ntwo" and out[0].title == "T"
    assert all(r.tokens <= 512 for r in out) and not any("no" == r.content for r in out)


def test_line_chunks_cover_texts(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"line {k}" for k in range(300))), (2, "")], "doc_id long, text string")
    out = chunking.line_chunks(docs, 500).orderBy("doc_id", "ordinal").collect()
    assert "\n".join(r.content for r in out if r.doc_id == 1) == docs.first().text
    assert [r.start_line for r in out if r.doc_id == 1][1:] == [r.end_line + 1 for r in out if r.doc_id == 1][:-1]


def test_hashed_vectors_are_stable():
    a = embedding.hashed("the quick fox", 32)
    assert np.allclose(a, embedding.hashed("The QUICK fox", 32)) and np.isclose(np.linalg.norm(embedding.hashed("", 8)), 1)


def test_vector_shards(spark, tmp_path):
    data = files.pack_shard([bytes(16), bytes(range(16))], np.array([[1, 2], [3, 255]]), [0.5, 1.0], [0.0, -1.0])
    (tmp_path / "a.bin").write_bytes(data)
    got = files.read_shards(spark, f"file://{tmp_path}").collect()
    assert {(r.id[:4], tuple(r.codes), r.scale) for r in got} == {("0000", (1, 2), 0.5), ("0001", (3, 255), 1.0)}


def test_file_tree_states(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("ok é")
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "c.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "x.skip").write_text("no")
    out = {r.path.rsplit("/", 1)[1]: (r.state, r.text) for r in files.tree(spark, f"file://{tmp_path}", deny=r"\.skip$").collect()}
    assert out == {"a.txt": ("text", "ok é"), "b.bin": ("binary", None), "c.txt": ("latin1", "é")}


def test_stable_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "id long, v string, at int")
    path = f"file://{tmp_path}/t"
    assert files.stable_write(rows, path, ("at",))
    assert not files.stable_write(rows.withColumn("at", F.lit(9)), path, ("at",))
    assert files.stable_write(rows.where("id = 1"), path, ("at",)) and spark.read.parquet(path).count() == 1


def test_expand_keeps_queries_apart(spark):
    edges = spark.createDataFrame([("a", 1, 2, 1.0), ("b", 3, 4, 1.0)], "rid string, src long, dst long, weight double")
    seeds = spark.createDataFrame([(10, 1, 1.0), (11, 3, 1.0)], "query_id long, node long, score double")
    out = {(r.query_id, r.node) for r in graph.expand(edges, seeds, by=("query_id",)).collect()}
    assert out == {(10, 1), (10, 2), (11, 3), (11, 4)}


def test_graph_search_adds_what_the_graph_reaches(spark):
    base = spark.createDataFrame([(1, 100, 1), (1, 101, 2)], "query_id long, doc_id long, rank int")
    mentions = spark.createDataFrame([("a", 100, 5), ("b", 200, 1), ("b", 201, 3), ("b", 202, 2)], "node string, doc_id long, weight int")
    edges = spark.createDataFrame([("e", "a", "b", 1.0)], "rid string, src string, dst string, weight double")
    out = {r.doc_id: (r.score, r.matched_by) for r in graph.search(base, mentions, edges, 1).collect()}
    assert out.keys() == {100, 101, 201, 202}
    assert out[100] == (pytest.approx(1 / 61, abs=1e-8), "hybrid") and out[201] == (pytest.approx(0.7 / 61, abs=1e-8), "graph")
    assert graph.search(base.limit(0), mentions, edges, 1).count() == 0


@pytest.mark.parametrize("budget, kept", [(100, [(1, 40, False), (2, 30, False)]), (30, [(1, 15, True)]), (15, []), (1000, [(1, 40, False), (2, 30, False), (3, None, False)])])
def test_hard_cap_counts_headers_and_footer(spark, budget, kept):
    rows = spark.createDataFrame([(1, 1, 40, 10), (1, 2, 30, 10), (1, 3, None, 10)], "query_id long, place int, tokens long, header long")
    out = [(r.place, r.tokens, r.shortened) for r in context.hard_cap(rows, budget, 5).orderBy("place").collect()]
    assert out == [(p, t or 0, s) for p, t, s in kept]


def test_min_score_and_scope(spark):
    hits = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, None)], "doc_id long, score double")
    assert [r.doc_id for r in S.at_least(hits, 0.5).collect()] == [1]
    said = spark.createDataFrame([("all",), ("project:a:b",), ("project:",), ("current",), ("other",), (None,)], "said string")
    got = [tuple(r.s) for r in said.select(S.scope(F.col("said")).alias("s")).collect()]
    assert got == [("all", None), ("project", "a:b"), ("project", ""), ("current", None), ("current", None), ("current", None)]


def test_vector_tiles_bound_memory_and_keep_ties(monkeypatch):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(4)
    m, q = rng.integers(-1, 2, (500, 6)).astype(float), S._unit(rng.integers(-1, 2, (40, 6)).astype(float))  # many equal scores
    vec = rng.permutation(500) + 1000
    for dims in (None, 4):
        score = np.round(S._unit(m) @ q.T, 6)
        coarse = np.round(S._coarse(m, dims) @ S._unit(q[:, :dims]).T, 6) if dims else score
        want = [(k, r) for k in range(40) for r in sorted(range(500), key=lambda r: (-coarse[r, k], vec[r]))[:10]]
        monkeypatch.setattr(S, "CELLS", 3000)
        got = [(a, b) for k, at, _, _ in S._best(vec, m, q, 10, dims) for a, b in zip(k.tolist(), at.tolist(), strict=True)]
        assert got == want
        few = [(a, b) for k, at, _, _ in S._best(vec[:7], m[:7], q, 10, dims) for a, b in zip(k.tolist(), at.tolist(), strict=True)]
        assert len(few) == 7 * 40
    monkeypatch.undo()
    tracemalloc.start()
    for _ in S._best(np.arange(10000), rng.random((10000, 64)), S._unit(rng.random((600, 64))), 100, 32):
        pass
    assert tracemalloc.get_traced_memory()[1] < 120e6  # the whole product alone is 48 MB in each of some eight arrays
    tracemalloc.stop()


def test_expand_reads_only_what_it_stands_on(spark, monkeypatch):
    edges = spark.createDataFrame([(f"{a}-{b}", a, b, 1.0 / (1 + b % 3)) for a in range(40) for b in range(40, 60) if (a * b) % 7 == 1], "rid string, src long, dst long, weight double")
    seeds = spark.createDataFrame([(1, 1.0), (2, 0.5)], "node long, score double")
    met, real = [], graph._at
    monkeypatch.setattr(graph, "_at", lambda rows, nodes: met.append(nodes.count()) or real(rows, nodes))
    want = sorted(map(tuple, graph.expand(edges, seeds, fanout=3).collect()))
    assert met[0] == 2 and len(met) == 4 and max(met) <= len(want)
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    assert sorted(map(tuple, graph.expand(edges, seeds, fanout=3).collect())) == want
