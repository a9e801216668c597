import hashlib
import random
import re
import zlib

from lorequarry.llm import secret_scan as s

BASE = {
    "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def brute(text):
    found = []
    for kind, p in BASE.items():
        for m in p.finditer(text):
            if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]:
                found.append((m.start(), list(BASE).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def checked(prefix, body):
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        tail = s._DIGITS[d] + tail
    return prefix + body + tail


def test_spans_equal_brute_force_on_random_texts():
    rng, keys = random.Random(5), s.automaton()
    parts = ["password", "Token", "SECRET", "api_key", "ApiKey", "ſecret", "=", ": ", '" : "', "abc123", "AKIA", "AKIA" + "Z9" * 9, "deadbeef" * 3, "0" * 23, "é", "日本", " ", "\n", "x", "'", "f" * 24, "token=secret=abcdef", "K"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))
        mine = [f"{k}:{a}:{b}" for a, b, k in s.spans(text.encode(), keys) if k in s.BASE_KINDS]
        assert mine == brute(text), text


def test_hex_runs_at_every_alignment():
    for pad in range(30):
        for n in (23, 24, 25, 31):
            data = b"z" * pad + b"a1" * 20
            data = data[: pad + n] + b"zz"
            assert s.hex_runs(data) == ([(pad, pad + n)] if n >= 24 else [])


def test_checksummed_tokens_only_when_the_checksum_holds():
    keys, good = s.automaton(), checked("ghp_", "A1b2C3" * 5)
    assert [x[2] for x in s.spans(f"see {good} there".encode(), keys)] == ["github"]
    assert s.spans(f"see {good[:-1]}_ there".encode(), keys) == []
    assert [x[2] for x in s.spans(checked("npm_", "q" * 30).encode(), keys)] == ["npm"]


def test_scan_edges_and_redaction(spark):
    long = "word " * 200_000 + "password = hunter2x"
    rows = [(1, None, 7), (2, "", 7), (3, long, 7), (3, long, 7), (None, "token: abcdefgh", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = {(r.doc_id, r.n_assign, r.spans) for r in s.scan(df).collect()}
    at = len("word " * 200_000)
    assert out == {(1, 0, ""), (2, 0, ""), (3, 1, f"assign:{at}:{at + 19}"), (None, 1, "assign:0:15")}
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in s.scan(df).collect() if r.doc_id in (1, 2)} == {empty}
    assert s.scan(df.limit(0)).count() == 0
    red = s.redact(spark.createDataFrame([(1, "a token = abcdefgh b", 20), (2, None, None)], "doc_id long, text string, n_chars long")).collect()
    assert red[0].text == "a [secret:assign] b" and red[0].n_chars == len(red[0].text) and red[1].text is None


def test_query_equals_brute_force(spark):
    from lorequarry.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_secret_scan"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in BASE)
