import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lorequarry.operators import render as R

PACK = "query_id long, query string, intent string, budget int, extra string"
FRAGMENT = "query_id long, place int, path string, first_line int, last_line int, name string, tokens int, score double, compressed boolean, strategy string, reason string, text string"


@pytest.fixture(scope="module")
def packs(spark):
    return spark.createDataFrame([(1, 'how does "login" <work>?', "code", 100, "x"), (2, None, None, 50, None)], PACK)


@pytest.fixture(scope="module")
def fragments(spark):
    rows = [
        (1, 2, "b.md", 3, 4, None, 7, 0.5, True, "prune", "keyword", "two & <b>"),
        (1, 1, "a.py", 1, 2, "f", 10, 1.23456789, False, None, "semantic", "one"),
        (1, 3, "b.md", 9, 9, "", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, FRAGMENT)


@pytest.fixture(scope="module")
def dropped(spark):
    rows = [(1, f"{k:020d}", "mmr: near another" if k % 2 else f"budget: {k}", k) for k in range(14)] + [(1, "z", None, 99)]
    return spark.createDataFrame(rows, "query_id long, id string, why string, place int")


def of(df):
    return {r.query_id: r.rendered for r in df.collect()}


def test_markdown(packs, fragments, dropped):
    got = of(R.markdown(packs, fragments, dropped))
    assert got[1] == (
        '# Contexto — how does "login" <work>?\n\n## [1] a.py:1-2 › f\n\none\n\n## [2] b.md:3-4  (comprimido)\n\ntwo & <b>\n\n## [3] b.md:9-9\n\n\n\n'
        "---\n2 fonte(s) · ~17 / 100 tokens · 15 candidatos descartados"
    )
    assert got[2] == "# Contexto — \n\n---\n0 fonte(s) · ~0 / 50 tokens"
    told = packs.select("query_id", F.lit("seen").alias("line")).where("query_id = 2")
    assert of(R.markdown(packs, fragments, None, False, told))[2] == "seen\n\n---\n0 fonte(s) · ~0 / 50 tokens"


def test_xml_is_well_formed_and_keeps_texts(packs, fragments):
    got = of(R.xml(packs, fragments))
    root = ElementTree.fromstring(got[1])
    assert root.get("query") == 'how does "login" <work>?'
    assert [(f.get("source"), f.get("lines"), f.get("compressed"), f.text.strip()) for f in root.findall("fragment")] == [("a.py", "1-2", "false", "one"), ("b.md", "3-4", "true", "two & <b>"), ("b.md", "9-9", "false", "")]
    assert root.find("meta").attrib == {"tokens": "17", "budget": "100", "sources": "2"}
    assert got[2] == '<context query="">\n  <meta tokens="0" budget="50" sources="0" />\n</context>'


def test_json_has_every_field(packs, fragments, dropped):
    got = {k: json.loads(v) for k, v in of(R.json(packs, fragments, dropped)).items()}
    assert [f["content"] for f in got[1]["fragments"]] == ["one", "two & <b>", ""]
    assert got[1]["fragments"][0]["score"] == 1.234568 and got[1]["fragments"][2]["symbol"] == "" and got[1]["fragments"][1]["symbol"] is None
    assert got[1]["dropped"] == 15 and [(r["n"], r["why"]) for r in got[1]["reasons"]] == [(7, "budget"), (7, "mmr"), (1, "")]
    assert len(got[1]["examples"]) == R.SHOWN
    assert got[2] == {"query": "", "intent": None, "estimated_tokens": 0, "budget": 50, "sources": [], "fragments": [], "dropped": 0, "reasons": [], "examples": []}


def test_explanation(packs, fragments, dropped):
    got = of(R.explain(packs, fragments.where("place < 3"), dropped))
    assert got[1].split("\n") == [
        "Intenção detectada: code", "Orçamento: 17 / 100 tokens", "", "INCLUÍDOS:",
        "  [1] a.py:1-2 › f", "       score 1.2346 · 10 tokens · via semantic",
        "  [2] b.md:3-4", "       score 0.5000 · 7 tokens · via keyword, comprimido por 'prune'",
        "", "DESCARTADOS (15):", "     7  budget", "     7  mmr", "     1  ",
        "", "  exemplos:", *[f"    {k:020d}"[:18] + f"  budget: {k}" for k in (0, 2, 4, 6, 8)],
    ]
    assert got[2] == "Intenção detectada: \nOrçamento: 0 / 50 tokens\n\nINCLUÍDOS:"


def test_queries_are_repeated_safely(spark):
    said = ["plain words here", "find Zx9Qw8Er7Ty6Ui5Op4 now", "Zx9Qw8Er7Ty6Ui5Op4", "a1b2c3d4e5f6", "w " * 60, "", None]
    want = ["plain words here", "find Zx9Q…5Op4 now", "Zx9Q…5Op4", R.MASKED, ("w " * 60)[:96] + "…", "", ""]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, q string")
    assert [r.e for r in rows.select("k", R.echo(F.col("q")).alias("e")).orderBy("k").collect()] == want


def test_nothing_in_nothing_out(packs, fragments, dropped):
    none = packs.limit(0)
    assert not of(R.markdown(none, fragments, dropped)) and not of(R.xml(none, fragments)) and not of(R.json(none, fragments)) and not of(R.explain(none, fragments))
