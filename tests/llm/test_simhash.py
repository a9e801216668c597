import random
import re

import numpy as np
import xxhash

from lorequarry.llm import simhash as s


def brute_fp(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows, radius=4):
    fps = {i: f for i, f in rows}
    ids, parent = sorted(fps), {i: i for i in fps}
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    arr = np.array([fps[i] for i in ids], dtype=np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[k]) <= radius):
            a, b = root(i), root(ids[j])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_every_pair_within_the_radius_shares_a_table():
    rng = random.Random(2)
    for radius, parts, bits in ((4, 1, 64), (4, 2, 64), (4, 4, 128), (2, 1, 64), (0, 1, 64), (3, 5, 64)):
        m = s.masks(radius, parts, bits)
        assert len(m) == parts * (2 ** (radius + 1) - 1)
        for _ in range(2000):
            diff = sum(1 << b for b in rng.sample(range(bits // parts * parts), parts * (radius + 1) - 1))
            assert any(not diff & x for x in m)


def test_fingerprints_equal_brute_force():
    rng = random.Random(4)
    words = ["A", "bé", "c\xa0d", "É", "x\x1cy", "longer", "\x85"]
    for n in (0, 1, 3, 4, 5, 60):
        for _ in range(20):
            text = "".join(rng.choice(words) + rng.choice([" ", "\t", "\n", "\x0b", "  "]) for _ in range(n))
            assert s.fingerprint(s.shingle_hashes(text.encode(), 4)) == brute_fp(text)


def test_links_join_what_pairs_within_the_radius_join_in_any_bucket_size(spark):
    rng = random.Random(6)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
    rows = list(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(s._signed(f),) for _, f in rows], "fp long").repartition(5)
    want = brute_components(rows)
    for bucket in (s.BUCKET, 4):
        roots = {r.node: r.root for r in s.near_components(nodes, ["fp"], 4, bucket=bucket).collect()}
        got = {}
        for i, f in rows:
            got.setdefault(roots.get(s._signed(f), s._signed(f)), []).append(i)
        mine = {i: min(g) for g in got.values() for i in g}
        assert mine == want


def test_digest_edges_and_query_equal_brute_force(spark):
    long = " ".join(str(i) for i in range(60_000))
    rows = [(5, None), (4, ""), (7, "a b"), (9, "A  B"), (9, "A  B"), (None, "a b"), (11, long)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in s.digest(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")).collect()]
    assert len(got) == len(rows)
    assert {(i, c) for i, _, c in got if i in (4, 5)} == {(4, 4), (5, 4)} and {c for i, _, c in got if i in (7, 9, None)} == {7}
    assert s.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    from lorequarry.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    fps = [(r.doc_id, brute_fp(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_components(fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_near_dedup"](spark, sf).collect()} == {(i, f"{f:016x}", want[i]) for i, f in fps}


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(6)]
    rows = [(i, b, "x") for i, b in enumerate(base)] + [(10 + i, b.replace(b.split()[200], "changed", 1), "x") for i, b in enumerate(base)]
    out = s.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, component string"))
    assert sorted(r.doc_id for r in out.collect()) == list(range(6)) and out.columns == ["doc_id", "text", "component"]


def brute_pairs(rows, reach, similarity, width=5):
    """The smallest id of each row's group, over all pairs within the reach whose exact shingle sets are similar (equal sets link)."""
    sets = {i: set(s.shingle_hashes(t.encode(), width).tolist()) for i, t in rows}
    fps = {i: set_fp(x) for i, x in sets.items()}
    least = {i: i for i, _ in rows}
    def root(i):
        while least[i] != i:
            i = least[i]
        return i
    for i in fps:
        for j in fps:
            if i < j and (sets[i] == sets[j] or (fps[i] ^ fps[j]).bit_count() <= reach and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {i: root(i) for i in least}


def set_fp(hashes):
    """128 bits of a set of hashes: the majority of the hashes, and of the hashes put through a finaliser of 64 bits."""
    def more(x):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31
    majority = lambda h: sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    return majority(hashes) | majority([more(x) for x in hashes]) << 64


def family(rng, n, words=60, changed=12):
    """Texts that share one passage: all close in fingerprint, of them a part similar."""
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = (rng.choice(out).split() if out and rng.random() < 0.4 else base)[:]
        for _ in range(rng.randrange(changed)):
            text[rng.randrange(words)] = f"x{rng.randrange(9999)}"
        out.append(" ".join(text))
    return out


def test_links_of_dense_families_grow_only_over_similar_pairs(spark, monkeypatch):
    rng = random.Random(10)
    # x is near y and z in bits but similar to neither, and y and z are similar
    sets = [np.arange(0, 10, dtype=np.uint64), np.arange(5, 25, dtype=np.uint64), np.arange(5, 24, dtype=np.uint64)]
    more = [np.arange(100 * k, 100 * k + 20, dtype=np.uint64) for k in range(1, 10)]
    assert s.similar_links(np.arange(24, dtype=np.uint64).reshape(12, 2), sets + more, 9, 0.8) == [(1, 2)]
    texts = [t for _ in range(3) for t in family(rng, 60)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(s, "masks", lambda *_: [0])  # a single bucket holds every fingerprint
    for reach in (18, 60):
        want = brute_pairs(rows, reach, 0.8)
        assert 3 < len(set(want.values())) < len(rows)
        for size in (s.SET_BYTES, 4096):
            monkeypatch.setattr(s, "SET_BYTES", size)
            got = {r.id: r.component for r in s.near_groups(docs, 5, 4, 4, reach, 0.8).collect()}
            assert got == want


def test_texts_of_one_fingerprint_and_pairs_about_the_limit_are_decided_exactly(spark):
    rng = random.Random(12)
    line = "again "
    own = [" ".join(f"{c}{k}" for k in range(40)) for c in "ab"]
    rows = [(k, line * 200 + t) for k, t in enumerate(own)]
    # one block of n words is new: similarity on either side of 0.8, at far more shingles than a sketch holds
    for k in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        n = 38 + k
        rows += [(10 + 2 * k, " ".join(words)), (11 + 2 * k, " ".join(words[: 400 - n] + [f"n{rng.randrange(10**6)}" for _ in range(n)]))]
    want = brute_pairs(rows, 60, 0.8)
    assert want[1] == 1 and 14 < len(set(want.values())) < 26
    s_masks = s.masks
    s.masks = lambda *_: [0]
    try:
        got = {r.id: r.component for r in s.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 4, 60, 0.8).collect()}
    finally:
        s.masks = s_masks
    assert got == want
    # equal shingle sets are one node whatever their repeats
    rows = [(3, "a b c d e f g " + "a b c d e f g " * 9), (1, "a b c d e f g " * 2), (2, "q r s t u")]
    assert {r.id: r.component for r in s.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 4, 0, 0.8).collect()} == {1: 1, 3: 1, 2: 2}


def test_groups_of_any_size_in_one_bucket_equal_brute_force(spark, monkeypatch):
    rng = random.Random(14)
    monkeypatch.setattr(s, "masks", lambda *_: [0])
    for n in (2, 8, 9, 100):
        rows = list(enumerate(family(rng, n)))
        want = brute_pairs(rows, s.REACH, 0.8)
        assert {r.id: r.component for r in s.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 4, s.REACH, 0.8).collect()} == want
    # a bucket of 20,000 is dealt into blocks: clusters of five, each a chain of single bits, far from all others
    want, fps = {}, []
    for k in range(4000):
        x = rng.getrandbits(64)
        for _ in range(5):
            want[s._signed(x)] = k
            fps.append((s._signed(x),))
            x ^= 1 << rng.randrange(64)
    nodes = spark.createDataFrame(fps, "fp long").distinct()
    roots = {r.node: r.root for r in s.near_components(nodes, ["fp"], 4).collect()}
    groups = {}
    for fp, k in want.items():
        groups.setdefault(k, set()).add(roots.get(fp, fp))
    assert all(len(g) == 1 for g in groups.values()) and len({r for g in groups.values() for r in g}) == 4000


def test_recall_of_the_pipeline_stage_on_real_rows(spark):
    """Of the pairs of different texts with similarity 0.8 or more, over nine in ten are in one group (all pairs by a prefix filter)."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").groupBy("text").agg({"doc_id": "min"}).toDF("text", "doc_id")
    rows = {r.doc_id: set(s.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in docs.collect()}
    seen = {}
    for x in rows.values():
        for h in x:
            seen[h] = seen.get(h, 0) + 1
    met, pairs = {}, set()
    for i, x in rows.items():
        rare = sorted(x, key=lambda h: (seen[h], h))[: len(x) - -(-8 * len(x) // 10) + 1]
        for h in rare:
            for j in met.setdefault(h, []):
                y = rows[j]
                if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and x != y and len(x & y) >= 0.8 * len(x | y):
                    pairs.add((i, j))
            met[h].append(i)
    found = {r.id: r.component for r in s.near_groups(docs, 5, 4, 4, s.REACH, 0.8).collect()}
    assert len(pairs) > 40 and sum(found[i] == found[j] for i, j in pairs) >= 0.9 * len(pairs)


def test_near_dedup_edges(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(5, None, 1), (4, "", 1), (None, "a b", 1), (7, "a b", 1), (7, "a b", 2), (9, "A  B", 1), (9, "A  B", 2), (11, long, 1), (12, long + " more", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_0 int").withColumnsRenamed({})
    out = s.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.gone_0) for r in out.collect()), key=str) == sorted([(4, 1), (7, 1), (7, 2), (11, 1), (None, 1)], key=str)
    assert s.near_dedup(docs.limit(0)).count() == 0


def test_near_dedup_drops_rows_by_id_and_text(spark):
    rows = [(1, "one and the same text here"), (2, "one and the same text here"), (2, "a thing that no other row says at all")]
    out = s.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[2]]
