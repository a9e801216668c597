"""Dictionary budgets against a plain loop, and reading levels."""

import random

from lorequarry.operators import dictionary as D


def plain(sections: dict[str, list[int]], budget: int) -> tuple[dict[str, int], int]:
    """Cut the last third of each section in turn while the whole is too large."""
    left = {k: list(v) for k, v in sections.items()}
    size = lambda: sum(map(sum, left.values()))
    for name, floor in D.FLOORS:
        while size() > budget and len(left.get(name, ())) > floor:
            left[name] = left[name][: max(len(left[name]) * 2 // 3, floor)]
    return {k: len(v) for k, v in left.items()}, size()


def test_cuts_equal_a_plain_loop(spark):
    pick, rows, want = random.Random(5), [], {}
    for project in range(40):
        sections = {s: [pick.randint(0, 60) for _ in range(pick.choice([0, 1, 4, 11, 30, 200]))] for s in ("glossary", "docs", "services", "data_stores", "modules", "technologies")}
        sections = {k: v for k, v in sections.items() if v}
        rows += [(project, s, i, t, "x") for s, v in sections.items() for i, t in enumerate(v, 1)]
        kept, size = plain(sections, 4000)
        want |= {(project, s): (len(sections[s]), n, size) for s, n in kept.items()}
    entries = spark.createDataFrame(rows, "project long, section string, place int, tokens int, n string")
    cuts = D.fitted(entries)
    got = {(r.project, r.section): (r.n, r.kept, r.total) for r in cuts.collect()}
    assert got == want and any(n != kept for n, kept, _ in want.values()) and any(size <= 4000 < size + 500 for _, _, size in want.values())
    left = D.kept_entries(entries, cuts).groupBy("project", "section").count().collect()
    assert {(r.project, r["section"]): r["count"] for r in left} == {k: v[1] for k, v in want.items()}


def test_nulls_floors_and_empty_tables(spark):
    rows = [(None, "glossary", i, 1000) for i in range(1, 10)] + [(None, None, 1, 10), (None, "docs", None, None), (1, "modules", 1, 9)]
    entries = spark.createDataFrame(rows, "project long, section string, place int, tokens int")
    got = {(r.project, r.section): (r.n, r.kept, r.total) for r in D.fitted(entries).collect()}
    assert got == {(None, "glossary"): (9, 5, 5010), (None, None): (1, 1, 5010), (None, "docs"): (1, 1, 5010), (1, "modules"): (1, 1, 9)}
    assert D.fitted(entries.limit(0)).count() == 0


def test_the_fullest_level_that_fits(spark):
    rows = [(1, "services", i, 10) for i in range(1, 31)] + [(1, "docs", i, 10) for i in range(1, 31)] + [(2, "glossary", 1, 10)]
    entries = spark.createDataFrame(rows, "project long, section string, place int, tokens int")
    # level 0: 8 services; level 1: 12 services and 10 docs; level 2: all
    for budget, want in ((50, (0, 80)), (219, (0, 80)), (220, (1, 220)), (599, (1, 220)), (600, (2, 600))):
        assert {r.project: (r.level, r.tokens) for r in D.reading_level(entries, budget).collect()} == {1: want, 2: (2, 10)}
