import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lorequarry.llm import prefix_trie as t
from lorequarry.llm.queries import ORACLES


def tie(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for key, of in members.items():
        under = [k for k in members if k[: len(key)] == key]
        children = [k for k in under if len(k) == len(key) + 1]
        leaves = [k for k in under if not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in under)]
        ends = ",".join(map(str, sorted(c for c in of if len(built[c]) == len(key))))
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in under if k)
        out.append((min(of), len(key), min(members[key[:-1]]) if key else None, len(of), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def hold(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(3)
    got = t.digest(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def many(seed, n=260, long=False):
    rng = random.Random(seed)
    texts = [("system", "be kind"), ("user", "hi"), ("user", "hïgh 😀"), ("assistant", "yes"), ("assistant", "no")]
    rows = []
    for c in range(n):
        v = [texts[0]] * (rng.random() < 0.6) + [rng.choice(texts) for _ in range(rng.randrange(0, 9))]
        if rng.random() < 0.3:
            v = texts[:4]
        rows += [(c, k, *x) for k, x in enumerate(v)]
    if long:
        rows += [(n + j, k, "user", f"t{k if j < 2 else k + j}") for j in range(3) for k in range(700)]
    return rows


@pytest.mark.parametrize("shard", [3, 50, 1 << 17])
def test_nodes_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(t, "SHARD", shard)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(shard, 10_000))
    try:
        hold(spark, many(shard))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, None, "a", ""), (1, 2, "a", "b"), (1, 2, "a", "b"), (-7, 1, "a", "b"), (7, 1, "a", "b"), (205, 1, "", ""), (100, 0, "s", "long " * 3000), (101, 0, "s", "q"), (101, 1, "s", "q")]
    hold(spark, rows)
    hold(spark, [(k, 0, "only", "one") for k in range(40)])
    hold(spark, [(7, 0, "only", "one")])
    hold(spark, [])


def test_long_conversations_with_a_shared_start(spark):
    hold(spark, many(4, 30, long=True))


def test_find_close_over_many_blocks(monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 4)
    rng = random.Random(2)
    for n in (1, 2, 7, 300):
        bits, depth, left = [], 0, n
        while left or depth:
            up = left and (not depth or rng.random() < 0.55)
            bits.append(bool(up))
            left, depth = left - bool(up), depth + (1 if up else -1)
        stack, want = [], {}
        for k, b in enumerate(bits):
            if b:
                stack.append(k)
            else:
                want[stack.pop()] = k
        p = np.flatnonzero(bits)
        assert t.Excess(np.array(bits)).close(p).tolist() == [want[k] for k in p.tolist()]


def test_sql_states_the_same(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(ORACLES["op11_prefix_trie"]).fetchall()
    names = [d[0] for d in con.description]
    got = t.digest(spark.read.parquet(f"{sf}/conversations.parquet")).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
