"""Requests to tasks: signals, trivial and damped requests, gates, impact, planned documents, tracks and edges."""

import pytest
from pyspark.sql import Row

from lorequarry.operators import decompose as D

RULES = [
    Row(rule="data", dimension="architecture", weight=50, pattern=r"(?i)\b(schema|index|foreign key)\b", hard=False),
    Row(rule="erase", dimension="risk", weight=75, pattern=r"(?i)\b(drop|erase)\b", hard=True),
    Row(rule="login", dimension="security", weight=65, pattern=r"(?i)\b(login|password)\b", hard=False),
    Row(rule="performance", dimension="complexity", weight=35, pattern=r"(?i)\bfaster\b", hard=False),
    Row(rule="price", dimension="business_rule", weight=55, pattern=r"(?i)\bprices?\b", hard=False),
    Row(rule="rename", dimension="complexity", weight=-30, pattern=r"(?i)\brename\b", hard=False),
    Row(rule="typo", dimension="complexity", weight=-60, pattern=r"(?i)\btypo\b", hard=False),
    Row(rule="vague", dimension="complexity", weight=20, pattern=r"(?i)\bmaybe\b", hard=False),
]
TYPES = [
    Row(type="decision", requires=[], triggers=["architecture"], min_score=50),
    Row(type="design", requires=["decision", "scope"], triggers=["complexity", "risk"], min_score=70),
    Row(type="scope", requires=[], triggers=["business_rule"], min_score=50),
    Row(type="threats", requires=["design"], triggers=["security"], min_score=60),
]
TEXTS = {1: "Fix a typo", 2: "typo, maybe", 3: "typo in the login page", 4: "Change the login", 5: "rename the schema and erase rows", 6: "new prices, a new schema, faster", 7: " ", 8: None, 9: "hello", 10: "loginpage"}


@pytest.fixture(scope="module")
def got(spark):
    requests = spark.createDataFrame(list(TEXTS.items()), "request_id long, text string")
    return {r.request_id: r for r in D.assess(requests, RULES).collect()}


def test_reducing_signals_make_requests_trivial_or_damp_them(got):
    assert [got[i].trivial for i in (1, 2, 3, 4, 5)] == [True, True, False, False, False]
    assert got[1].total == 0 and got[1].strategy == "execute" and got[1].scores.documentation == 0
    # peak 65 * 1 / 1.3, mean (65 * 1 + 40 * 0.8) / 1.8, two of seven dimensions: 47, of which six tenths stay
    assert got[4].total == 47 and got[3].total == 28 and got[4].fired == ["login"]


def test_gates_lift_what_a_mean_leaves_low(got):
    assert (got[4].band, got[4].requires_documentation, got[4].requires_approval, got[4].nature) == ("documentation", True, True, "security")
    assert (got[3].band, got[3].requires_documentation, got[3].requires_approval) == ("analysis", False, True)  # damped, not hard
    assert got[5].requires_documentation and got[5].requires_approval  # damped, but hard
    assert got[6].nature == "product" and got[9].nature in ("direct", "unknown") and got[10].fired == []


def test_blank_requests_are_direct(got):
    for i in (7, 8):
        assert (got[i].total, got[i].band, got[i].strategy, sum(got[i].scores)) == (0, "direct", "execute", 0)


def test_impact_counts_modules_code_and_documents(spark):
    hits = [(1, "src/a/x.py"), (1, "src\\a\\y.py"), (1, "docs/n.MD"), (1, "@base/d/n.md"), (2, "one.py"), (3, "docs/a.md"), (3, "docs/b.md"), (3, "docs/c.md"), (3, "docs/d.md")]
    rows = D.impact(spark.createDataFrame(hits, "request_id long, path string"))
    assert {tuple(r) for r in rows.collect()} == {(1, 42, 28), (2, 15, 60), (3, 48, 0)}
    requests = spark.createDataFrame([(1, "hello"), (4, "hello"), (2, "typo")], "request_id long, text string")
    scores = {r.request_id: (r.scores.dependency, r.scores.documentation) for r in D.assess(requests, RULES, rows).collect()}
    assert scores == {1: (42, 28), 4: (0, 60), 2: (0, 0)}


def test_tracks_documents_and_edges(spark):
    requests = spark.createDataFrame([(i, TEXTS[i]) for i in (4, 6, 9)], "request_id long, text string")
    assessed = D.assess(requests, RULES)
    tasks, tracks = D.decompose(assessed, TYPES).collect(), {}
    for t in sorted(tasks, key=lambda t: (t.request_id, t.seq)):
        tracks.setdefault(t.request_id, []).append(t.track)
    assert tracks[9] == ["analysis", "backend", "tests", "validation"]
    assert tracks[4] == ["analysis", "documentation", "backend", "tests", "security", "validation"]
    assert tracks[6] == ["analysis", "documentation", "database", "backend", "integration", "frontend", "tests", "validation"]
    by = {(t.request_id, t.track): t for t in tasks}
    assert by[4, "documentation"].documents == ["decision", "scope", "design", "threats"] and by[6, "documentation"].documents == ["decision", "scope"]
    assert by[4, "security"].priority == "critical" and by[4, "security"].approve and not by[6, "database"].approve
    names = {t.task_id: t.track for t in tasks if t.request_id == 6}
    found = {(names[e.task_id], names[e.depends_on]) for e in D.edges(assessed, TYPES).collect() if e.request_id == 6}
    assert found == {("documentation", "analysis"), ("database", "documentation"), ("backend", "documentation"), ("backend", "database"), ("integration", "backend"), ("frontend", "backend"), ("tests", "backend"), ("validation", "tests")}
    assert D.decompose(D.assess(requests.limit(0), RULES), TYPES).count() == 0


def test_catalogues_are_bounded_and_checked(spark):
    table = spark.createDataFrame(RULES)
    assert [r.rule for r in D.catalogue(table, "rule")] == [r.rule for r in RULES]
    for broken in (
        lambda: D.catalogue(table, "rule", 3),
        lambda: D.signals(D.F.col("text"), [Row(rule="x", dimension="mood", weight=1, pattern="x", hard=False)]),
        lambda: D.ordered_types([Row(type="a", requires=["b"]), Row(type="b", requires=["a"])]),
        lambda: D.ordered_types([Row(type="a", requires=["z"])]),
    ):
        with pytest.raises(ValueError):
            broken()
