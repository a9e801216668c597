import pytest

from lorequarry.functions import text as T
from lorequarry.operators import compress as c


def run(spark, text, target, query="", code=False):
    df = spark.createDataFrame([(text, target, query, code)], "text string, target int, q string, code boolean")
    r = c.compress(df, target=c.F.col("target"), query=c.F.col("q"), is_code=c.F.col("code")).withColumn("n", T.token_count(c.F.col("compressed"))).first()
    return r.compressed, r.strategy, r.saved_tokens, r.n


BODY = "\n".join(f"    x{i} = {i}" for i in range(200))


def test_what_fits_stays(spark):
    assert run(spark, "a short line", 500)[:3] == ("a short line", "none", 0)
    assert run(spark, None, 5)[:3] == ("", "none", 0)


def test_noise_goes_first(spark):
    text = "# Copyright 2026 Someone\nimport os\nfrom typing import Any\n\n\n\ndef real():\n    return 1\n"
    assert run(spark, text, 8, code=True)[:2] == ("def real():\n    return 1", "prune")
    assert run(spark, text, 19)[0] == "import os\nfrom typing import Any\n\ndef real():\n    return 1"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"def f(a, b):\n{BODY}\n", "def f(a, b):\n    # ... (200 linhas omitidas)"),
        (f'@wrap\nasync def f():\n    """Says one thing."""\n{BODY}', '@wrap\nasync def f():\n    """Says one thing."""\n    # ... (200 linhas omitidas)'),
        (f"def f():\n    '''Two\n    lines.'''\n{BODY}", "def f():\n    '''Two\n    lines.'''\n    # ... (200 linhas omitidas)"),
        (f"x = 1\n{BODY}", "x = 1\n    # ... (200 linhas omitidas)"),
    ],
)
def test_bodies_collapse_to_signature_and_docstring(spark, text, want):
    got, strategy, saved, _ = run(spark, text, 40, code=True)
    assert (got, strategy) == (want, "collapse") and saved > 100


def test_an_open_docstring_is_truncated(spark):
    got, strategy, _, n = run(spark, 'def f():\n    """Never closed\n' + BODY, 30, code=True)
    assert strategy == "truncate" and got.startswith("def f():") and got.endswith(c.TRUNCATED) and n <= 30


def test_sentences_near_the_query_and_the_heading_stay(spark):
    said = [f"Sentence number {i} about any matter." for i in range(60)]
    said[41] = "How login works here."
    got, strategy, _, n = run(spark, "## Login\n\n" + " ".join(said), 40, query="login works")
    assert strategy == "sentences" and n <= 40 and got == "## Login\n" + " ".join([said[0], said[1], said[41]])


def test_truncation_is_marked(spark):
    got, strategy, _, _ = run(spark, "word " * 800, 20)
    assert strategy == "truncate" and got == ("word " * 12) + "\n" + c.TRUNCATED
    assert run(spark, "aa\n" * 50, 10)[0].split("\n")[-1] == c.TRUNCATED
