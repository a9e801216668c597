import random

from lorequarry.llm import exact_dedup as e


def test_fingerprints_compose():
    rng = random.Random(1)
    for n in (0, 1, e.CHUNK - 1, e.CHUNK, e.CHUNK + 1, 5 * e.CHUNK + 17):
        data = rng.randbytes(n)
        k = rng.randrange(n + 1)
        plain = 0
        for b in data:
            plain = (plain * e.BASE + b) % e.PRIME
        assert e.fingerprint(data) == plain == e.combine(e.fingerprint(data[:k]), e.fingerprint(data[k:]), n - k)


ROWS = [(1, "Abc", 0), (2, "aBC", 0), (3, None, 0), (4, "", 0), (5, "É", 0), (6, "é", 0), (7, "z" * 50_000, 0), (8, "Z" * 50_000, 0), (8, "Z" * 50_000, 1), (None, "abc", 0), (9, "z" * 49_999 + "y", 0)]


def brute(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for r in rows:
        groups.setdefault(low(r[1]), []).append(r[0])
    return sorted((r[0] or 0, max((i for i in groups[low(r[1])] if i is not None), default=None), len(groups[low(r[1])])) for r in rows)


def test_decisions_equal_brute_force_even_when_fingerprints_collide(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, fp int")
    for modulus in (e.PRIME, 2, 1):
        got = e.decisions(df, modulus=modulus).collect()
        assert sorted((r.id or 0, r.keep_id, r.group_size) for r in got) == brute(ROWS)
        assert sum(r.kept for r in got) == 6


def test_dedup_keeps_columns_and_one_row_a_group(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, fp int")
    out = e.dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 6, 8, 9]
    assert e.dedup(df.limit(0)).count() == 0 and e.digest(df.limit(0)).count() == 0
