"""Units of code and prose: golden cases, cuts, joins, ids, contexts, and what a second run invalidates."""

import pytest
from pyspark.sql import functions as F

from lorequarry.operators import units as U

CLASS = 'import os\n\n\nclass AuthService:\n    """Signs in. And out."""\n\n    def login(self, user):\n        """Login."""\n        token = os.environ.get(user)\n        return token\n\n    @property\n    def logout(self):\n        return True\n\n\ndef helper():\n    return 1\n'


def made(lang, text, most=512, least=24, path="src/a.py"):
    return U.chunks(path, lang, text, most, least)[0]


def test_class_header_lists_methods_and_leaves_their_bodies_out():
    got = made("python", CLASS, least=0)
    assert [(c.kind, c.symbol) for c in got] == [("file", None), ("class", "AuthService"), ("method", "AuthService.login"), ("method", "AuthService.logout"), ("function", "helper")]
    head, login, logout = got[1:4]
    assert "return token" not in head.content and head.content.endswith("# métodos: login, logout")
    assert login.content.startswith("    def login") and login.content.endswith("return token")
    assert logout.content.startswith("    @property") and login.parent is head and logout.parent is head


def test_long_functions_become_named_parts_at_whole_lines():
    body = "\n".join(f"    x{i} = {i} + {i} * {i}" for i in range(400))
    got = made("python", f"def large():\n{body}\n", most=100)
    assert len(got) > 1 and [c.symbol for c in got] == [f"large#part-{k}" for k in range(1, len(got) + 1)]
    assert max(c.tokens for c in got) <= 120 and "\n".join(c.content for c in got) == f"def large():\n{body}"


def test_fences_and_tables_are_never_cut_and_headings_stay():
    fence = "\n\n".join(f"line {i} of code with some text" for i in range(60))
    rows = "\n".join(f"| {i} | some cell of text |" for i in range(60))
    text = f"# T\n\n## S\n\nintro\n\n```python\n# not a heading\n{fence}\n```\n\nmiddle\n\n{rows}\n\nend\n"
    got = made("markdown", text, most=50)
    assert [c.heading for c in got if c.heading != "T"] == ["T > S"] * (len(got) - 1) and len(got) > 2
    assert sum(c.content.count("```") for c in got) == 2 and any(c.content.count("```") == 2 for c in got)
    assert any(rows in c.content for c in got)
    long = "\n\n".join(f"Paragraph {i} with enough text to use tokens." for i in range(80))
    cut = made("markdown", f"# T\n\nBuild\n-----\n\n{long}\n", most=60)
    assert len(cut) > 5 and {c.heading for c in cut[1:]} == {"T > Build"}


def test_tiny_neighbours_join_only_within_kind_parent_and_two_lines():
    near = "\n\n".join(f"def g{i}():\n    return {i}" for i in range(8))
    got = made("python", near + "\n", least=40)
    assert len(got) < 8 and got[0].content.startswith("def g0") and got[0].last > 2
    far = "\n\n\n\n".join(f"def g{i}():\n    return {i}" for i in range(3))
    assert len(made("python", far, least=40)) == 3
    assert [c.kind for c in made("python", "import os\ndef f():\n    pass\n", least=40)] == ["file", "function"]


def test_equal_contents_keep_ids_and_lines_of_their_own():
    got = made("markdown", "# note\n\n\n# note\n\n\n# note\n", least=0, path="d.md")
    again = made("markdown", "# note\n\n\n# note\n\n\n# note\n", least=0, path="d.md")
    assert len({c.id for c in got}) == len(got) and [c.id for c in got] == [c.id for c in again]
    assert len({c.first for c in got}) == len(got)


@pytest.mark.parametrize(
    "lang, text, names",
    [
        ("json", '{\n  "a": 1,\n  "b": {\n    "c": 2\n  }\n}', [None, "$.a", "$.b"]),
        ("toml", 'x = 1\n[tool]\na = 1\n[[more]]\nb = 2\n', [None, "tool", "more"]),
        ("yaml", "# note\na: 1\nb:\n  c: 2\n---\nd: 1\n", [None, "a", "b", "---", "d"]),
        ("xml", "<?xml version='1.0'?>\n<a>\n  <b.c/>\ntext\n</a>", [None, "a", "b.c"]),
        ("sql", "CREATE TABLE IF NOT EXISTS t.x (a int);\nSELECT 1\nFROM t;\n", ["t.x", None]),
    ],
)
def test_structured_texts_are_cut_at_their_marks(lang, text, names):
    got = made(lang, text, least=0)
    assert [c.symbol for c in got] == names
    if lang != "json":
        assert "\n".join(c.content for c in got) == text


def test_every_xml_block_is_kept():
    assert len(made("xml", "\n".join(f"<n{i}>" for i in range(500)), least=0)) == 500


def test_units_through_spark_with_nulls_refused_and_clashing_columns(spark):
    rows = [(1, "src/a.py", "python", CLASS, "x"), (2, "b.py", "python", "def broken(:\n\nend", "x"), (3, "c.md", "markdown", None, "x"), (4, None, None, "one\n\ntwo", "x"), (5, "e.py", "python", "", "x"), (None, "f.py", "python", "def f():\n    return 1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, lang string, text string, content string")
    got = U.units(docs, least=0).orderBy("doc_id", "ordinal").collect()
    count = {i: sum(r.doc_id == i for r in got) for i in (1, 2, 3, 4, 5, None)}
    assert count == {1: 5, 2: 2, 3: 0, 4: 2, 5: 0, None: 1}
    assert {r.doc_id for r in got if r.degraded} == {2}
    by = {r.symbol: r for r in got if r.doc_id == 1}
    assert by["AuthService.login"].parent_id == by["AuthService"].chunk_id
    assert by["AuthService"].context == "src/a.py › class AuthService › a auth service › class AuthService: › Signs in."
    assert by["AuthService.login"].context == "src/a.py › method AuthService.login › a auth service login › def login(self, user): › Login."
    assert by["helper"].context == "src/a.py › function helper › def helper():"
    assert U.units(docs.limit(0)).count() == 0


def test_a_renamed_class_keeps_its_methods_but_not_their_vectors(spark):
    docs = spark.createDataFrame([(1, "a.py", "python", CLASS)], "doc_id long, path string, lang string, text string")
    old, new = U.units(docs, least=0), U.units(docs.withColumn("text", F.replace("text", F.lit("AuthService"), F.lit("Door"))), least=0)
    changes = U.rechunked(old, new)
    got = {tuple(r) for r in changes.groupBy("state", "embed").count().collect()}
    assert got == {("added", True, 1), ("removed", False, 1), ("moved", True, 2), ("kept", False, 2)}
    kept = U.valid_vectors(old.select("chunk_id", "symbol"), changes)
    assert {r.symbol for r in kept.collect()} == {None, "helper"}


def test_each_line_is_counted_once(monkeypatch):
    counted = []
    real = U.count_tokens
    monkeypatch.setattr(U, "count_tokens", lambda text: counted.append(text) or real(text))
    body = "".join(f"    def m{k}(self):\n        return '{'longish words, ' * (60 if k % 3 else 2)}'\n\n" for k in range(12))
    prose = "# Head\n\n" + "some words of prose\r\n\r\n" * 90 + "\ttiny é_x\n" * 3
    for lang, text in (("python", f"import os\n\nclass Body:\n{body}"), ("markdown", prose), ("sql", "SELECT 1;\n" * 40), (None, "a\n\n\nb\r")):
        counted.clear()
        made, _ = U.chunks("p", lang, text, 64, 24)
        assert len(counted) <= len(U.re.split(r"\r\n|\r|\n", text)) + 1  # and the names of a class's methods
        assert [c.tokens for c in made] == [sum(-(-len(t) // 4) for t in U.re.findall(r"\w+|[^\w\s]", c.content)) for c in made] and made
