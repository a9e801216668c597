import math
import statistics

import pytest
from pyspark.sql import functions as F

from lorequarry.operators import evaluation as E
from lorequarry.sources import cases as C

CASE, HIT = "query_id long, class string, difficulty string", "mode string, query_id long, rank int, doc_id long, score double"


@pytest.fixture(scope="module")
def rows(spark):
    cases = spark.createDataFrame([(1, "a", "easy"), (2, "a", "hard"), (3, None, "hard"), (4, "none", "easy"), (5, "none", "easy")], CASE)
    wanted = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 20), (3, 30)], "query_id long, doc_id long")
    hits = [
        ("k", 1, 1, 10, 9.0), ("k", 1, 2, 10, 8.0), ("k", 1, 3, 11, 7.0), ("k", 2, 1, 5, 6.0), ("k", 2, 7, 20, 1.0), ("k", 4, 1, 1, 9.0), ("k", 5, 1, 1, 8.9),
        ("s", 2, 1, 20, 0.5), ("s", 3, 11, 30, 0.1), ("other", 1, 1, 10, 1.0),
    ]
    return E.judged(cases, wanted, spark.createDataFrame(hits, HIT), ("k", "s", "h"))


def test_a_document_gains_once_at_its_first_place(rows):
    got = {(r.mode, r.query_id): (r.answerable, r.first, r.ndcg and round(r.ndcg, 6), r.top) for r in rows.collect()}
    assert len(got) == 15
    ideal = 1 + 1 / math.log2(3)
    assert got["k", 1] == (True, 1, round((1 + 0.5) / ideal, 6), 9.0)
    assert got["k", 2] == (True, 7, round(1 / 3, 6), 6.0)
    assert got["k", 3] == (True, None, 0.0, None) and got["s", 3] == (True, None, 0.0, None)
    assert got["k", 4] == (False, None, None, 9.0) and got["h", 1] == (True, None, 0.0, None)


def test_metrics_of_modes(rows):
    got = {r["mode"]: r.asDict() for r in E.mode_metrics(rows).collect()}
    k = got["k"]
    assert (k["cases"], k["hits"], k["no_answer_cases"], k["threshold"], k["false_positives"]) == (3, 1, 2, 9.0, 1)
    assert k["recall_at_5"] == pytest.approx(1 / 3) and k["mrr"] == pytest.approx((1 + 1 / 7) / 3) and 0 < k["low"] < 1 / 3 < k["high"] < 1
    assert (got["h"]["hits"], got["h"]["threshold"], got["h"]["false_positives"], round(got["h"]["low"], 9)) == (0, None, 0, 0.0)
    groups = {(r["mode"], r["by"], r["key"]): (r["hits"], r["cases"]) for r in E.mode_groups(rows).collect()}
    assert groups["k", "class", "a"] == (1, 2) and groups["k", "class", None] == (0, 1) and groups["s", "difficulty", "hard"] == (1, 2)
    assert {(r["mode"], r["query_id"], r["first"]) for r in E.failures(rows).where("mode <> 'h'").collect()} == {("k", 2, 7), ("k", 3, None), ("s", 1, None), ("s", 3, None)}


def test_the_threshold_is_the_order_statistic(spark):
    said = [(f"m{n}", k, True, 1, 1.0, float(k)) for n in range(1, 43) for k in range(n)]
    rows = spark.createDataFrame(said, "mode string, query_id long, answerable boolean, first int, ndcg double, top double").withColumn("class", F.lit("")).withColumn("difficulty", F.lit(""))
    got = {r["mode"]: r["threshold"] for r in E.mode_metrics(rows).collect()}
    assert got == {f"m{n}": float((n - 1) // 10) for n in range(1, 43)}


def test_savings_need_both_sides(spark):
    runs = [
        ("base", 1, 0, 100, True, None), ("arm", 1, 0, 60, True, None), ("base", 1, 1, 100, True, None), ("arm", 1, 1, 60, False, None), ("base", 2, 0, 0, True, None), ("arm", 2, 0, 1, True, None),
        ("base", 3, 0, 10, True, "x"), ("arm", 3, 0, 1, True, None), ("base", 4, 0, 200, True, None), ("arm", 4, 0, 50, True, None), ("worse", 4, 0, 300, True, None), ("worse", 1, 0, 150, True, None),
    ]
    rows = spark.createDataFrame(runs, "arm string, task long, rep int, billable long, hit boolean, error string")
    assert {(r.arm, r.task, r.saving) for r in E.savings(rows, "base").collect()} == {("arm", 1, 0.4), ("arm", 4, 0.75), ("worse", 4, -0.5), ("worse", 1, -0.5)}
    got = {r.arm: r for r in E.comparisons(rows, "base", 10).collect()}
    assert (got["arm"].pairs, got["arm"].label, got["worse"].label) == (2, "economiza", "não economiza")
    q = statistics.quantiles([0.4, 0.75], n=4, method="inclusive")
    assert (got["arm"].q1, got["arm"].q3) == (pytest.approx(q[0]), pytest.approx(q[2]))
    assert {r.label for r in E.comparisons(rows, "base", 9).collect()} == {"inconclusivo"}
    assert not E.comparisons(rows.limit(0), "base", 10).collect()


def test_case_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("- query: where is é?\n  relevant_paths: [src/a.py, src/a.py, gone.py]\n  difficulty: hard\n- query: nothing\n  class: sem_resposta\n  relevant_paths: [src/a.py]\n", encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"query": "no paths", "note": "n"}]')
    (tmp_path / "c.yml").write_text("")
    (tmp_path / "d.txt").write_text("no cases")
    got = C.read(spark, str(tmp_path))
    said = {(r.query, tuple(r.relevant_paths), r["class"], r.difficulty, r.note, r.answerable) for r in got.collect()}
    assert said == {("where is é?", ("src/a.py", "src/a.py", "gone.py"), "factual", "hard", "", True), ("nothing", ("src/a.py",), "sem_resposta", "easy", "", False), ("no paths", (), "factual", "easy", "n", False)}
    docs = spark.createDataFrame([(7, "src/a.py", 1), (8, "other", 2)], "doc_id long, path string, query long")
    assert [(r.ordinal, r.doc_id) for r in C.relevant(got, docs).collect()] == [(0, 7)]
    for bad in ("query: x", "- relevant_paths: [a]", "- [", "- query: ''"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(Exception, match="bad.yaml"):
            C.read(spark, str(tmp_path)).collect()
