import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.functions import ids as I
from lorequarry.functions import stats as ST
from lorequarry.functions import text as T
from lorequarry.functions import vector as V


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, count", [("", 0), ("abcd", 1), ("abcde", 2), ("a b", 2), ("hello, world!", 6), ("éèêëé", 2), ("x_y+1", 3)])
def test_token_count(spark, text, count):
    assert one(spark, T.token_count(F.col("t")), t=text) == count


def test_snippets(spark):
    s = lambda t, n: one(spark, T.snippet(F.col("t"), n), t=t)
    assert s("short  \n", 20) == "short"
    assert s("line one here\nline two is long", 20) == "line one here…"
    assert s("a\nwords that run on and on", 20) == "a\nwords that run on…"
    assert s("x" * 30, 10) == "x" * 10 + "…"
    assert one(spark, T.line_snippet(F.col("t"), 5), t="\n  \n  first line") == "first"


def test_detectors_and_intents(spark):
    assert one(spark, T.is_question(F.col("t")), t="Como funciona isto") and not one(spark, T.is_question(F.col("t")), t="isto funciona")
    assert one(spark, T.is_identifier(F.col("t")), t="AuthService") and not one(spark, T.is_identifier(F.col("t")), t="auth service")
    for text, want in (("implementar login", "implement"), ("where is it", "locate"), ("fix the bug", "fix"), ("review this", "review"), ("nothing", "general"), ("criar e revisar", "implement")):
        assert one(spark, T.intent(F.col("t")), t=text) == want


def test_names_routes_and_paths(spark):
    assert one(spark, T.split_identifier(F.col("t")), t="AuthService_x.HTTPServer") == ["auth", "service", "http", "server"]
    assert one(spark, T.query_terms(F.col("t")), t="AuthService auth login_now") == ["authservice", "auth", "service", "login_now", "login", "now"]
    for path, want in (("users/{id}//x", "/users/{}/x"), ("/u/:name/<int:k>", "/u/{}/{}"), ("/a/%s", "/a/{}")):
        assert one(spark, T.route(F.col("t")), t=path) == want
    for path, want in (("a/b", True), ("/a", False), ("../a", False), ("a/../b", False), ("C:\\a", False), ("a..b/c", True)):
        assert one(spark, T.valid_path(F.col("t")), t=path) is want
    assert one(spark, T.artifact_name(F.col("t")), t="src/a/b.py") == "src__a__b.py"
    assert one(spark, T.clean_subject(F.col("t")), t="feat(core): add x (ABC-12)") == "add x"
    assert one(spark, T.tier(F.col("t")), t="task/tests-plan.md") == "work" and one(spark, T.tier(F.col("t")), t="src/tests/a.py") == "test"
    assert one(spark, T.slug(F.col("t")), t="Usar o novo Login para Admin") == "login-admin"


def test_identity(spark):
    import hashlib

    assert one(spark, I.normalize_text(F.col("t")), t="\n\na  \r\nb\t\rc\n\n") == "a\nb\nc"
    assert one(spark, I.normalize_path(F.col("t")), t="./a\\b") == "a/b" and one(spark, I.normalize_path(F.col("t")), t="/a") is None
    assert one(spark, I.digest(F.col("t"), F.lit("v")), t="x") == hashlib.sha256(b"x\0v").hexdigest()[:32]
    assert one(spark, I.shard_of(F.col("t"), 16), t="0000001f" + "0" * 24) == "0f"


def test_statistics(spark):
    low, high = ST.wilson(F.col("h"), F.col("n"))
    assert one(spark, low, h=0, n=0) == 0 == one(spark, high, h=0, n=0)
    assert one(spark, low, h=8, n=10) == pytest.approx(0.4902, abs=1e-4) and one(spark, high, h=8, n=10) == pytest.approx(0.9433, abs=1e-4)
    assert one(spark, ST.entropy(F.col("t")), t="aabb") == pytest.approx(1.0) and one(spark, ST.entropy(F.col("t")), t="") == 0
    assert one(spark, ST.looks_random(F.col("t")), t="k3J9xQ2mL8vT") and not one(spark, ST.looks_random(F.col("t")), t="aaaaaaaaaaaa")
    assert one(spark, ST.hop_penalty(F.col("d")), d=4) == pytest.approx(1 / math.log(4 + math.e))


def test_vectors_round_trip(spark):
    rng = random.Random(1)
    v = [rng.gauss(0, 1) for _ in range(8)]
    u = np.array(v) / np.linalg.norm(v)
    got = one(spark, V.dequantized(V.quantized(F.array(*map(F.lit, v)), 8)))
    assert np.abs(np.array(got) - u).max() <= (u.max() - u.min()) / 255 / 2 + 1e-9
    assert one(spark, V.normalized(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_bootstrap_is_reproducible():
    from lorequarry.operators.evaluation import interval

    rng = random.Random(2)
    values = [rng.random() for _ in range(30)]
    low, high = interval(values)
    assert (low, high) == interval(values) and low <= statistics.median(values) <= high and interval([]) == (0, 0)
