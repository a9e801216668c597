import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.compute  # noqa: F401
import pytest

from lorequarry.llm import pst as p


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", low)


def brute(rows, share, least_, depth=3):
    """The definition by dictionaries over tuples of words."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    tokens = [[*split(t), ""] for _, t in rows]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    least = max(least_, math.ceil(share * n))
    grams = Counter()
    for t in train:
        full = ["^", *t]
        for k in range(len(full)):
            for m in range(2, depth + 2):
                g = tuple(full[k : k + m])
                if len(g) == m and not (g[0] != "^" and any(c[w] < least and w != "" for w in g)) and not (g[0] == "^" and any(c[w] < least and w != "" for w in g[1:])):
                    grams[g] += 1
    kept = {g: k for g, k in grams.items() if k >= least}
    times = lambda s: kept[s] if len(s) > 1 else (len(train) if s == ("^",) else c[s[0]])
    root = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    states = {}

    def prob(s, w):
        while s and s not in states:
            s = s[1:]
        if not s:
            return root(w)
        own, left = states[s]
        return own.get(w, 0.0) + left * prob(s[1:], w)

    for m in range(1, depth + 1):
        of = defaultdict(dict)
        for g, k in kept.items():
            if len(g) == m + 1:
                of[g[:-1]][g[-1]] = k
        new = {}
        for s, nxt in of.items():
            own = {w: (k - 0.5) / times(s) for w, k in nxt.items()}
            left = 1 - sum(own.values())
            gain = sum(k * math.log(own[w] / prob(s[1:], w) + left) for w, k in nxt.items()) + (times(s) - sum(nxt.values())) * math.log(left)
            if gain > len(nxt) * math.log(max(n, 2)) / 2:
                new[s] = (own, left)
        states |= new
    out = []
    for (i, _), h, t in zip(rows, held, tokens, strict=True):
        full, score = ["^", *t], 0.0
        for k in range(1, len(full)):
            s = []
            for w in reversed(full[max(0, k - depth) : k]):
                if w != "^" and c[w] < least:
                    break
                s.insert(0, w)
            score += math.log10(prob(tuple(s), full[k]))
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(root(w)) for w in t), score, len(states)))
    return out


def hold(spark, rows, share=p.SHARE, least=p.LEAST):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(3)
    got = sorted((tuple(r) for r in p.digest(df).collect()), key=str)
    want = sorted(brute(rows, share, least), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[7] == w[7] and g[5:7] == pytest.approx(w[5:7], rel=1e-9, abs=1e-9)
    return got


@pytest.mark.parametrize("share", [1e-6, 0.002])
def test_scores_are_the_definition(spark, monkeypatch, share):
    monkeypatch.setattr(p, "SHARE", share)
    monkeypatch.setattr(p, "SPAN", 300)
    monkeypatch.setattr(p, "RUN", 500)
    rng = random.Random(5)
    phrases = [["the", "old", "house", "by", "the", "sea"], ["a", "Green", "apple", "a", "day"], ["of", "the", "people", "by", "the", "people"]]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(1, 9)):
            words += rng.choice(phrases) if rng.random() < 0.7 else [f"w{rng.randrange(400)}", "the"]
        rows.append((i, " ".join(words)))
    got = hold(spark, rows, share)
    assert got[0][7] > 3
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1]) + 10  # unseen texts are likelier than under the root


def test_few_hot_words_and_ngrams(spark, monkeypatch):
    rng = random.Random(6)
    phrases = ["the old house by the sea", "a green apple a day", "of the people by the people"]
    rows = [(i, " ".join(rng.choice(phrases) if rng.random() < 0.6 else f"w{rng.randrange(60)} the" for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    monkeypatch.setattr(p, "HOT_WORDS", 3)
    monkeypatch.setattr(p, "HOT", 5)  # the rest comes from joins
    hold(spark, rows)
    monkeypatch.setattr(p, "HOT_WORDS", 0)
    monkeypatch.setattr(p, "HOT", 0)
    hold(spark, rows)


def test_states_do_not_need_a_share_of_the_corpus(spark):
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1]
    other = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(i, "a " * 1_100_000) for i in train[:5]] + [(i, "q r s t u v") for i in [*train[5:9], other]]  # four in 5.5 million tokens
    got = {r.doc_id: r for r in p.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[other]
    assert got.held_out and got.n_known == 7 and got.train_tokens == 5_500_033
    assert got.base_score == pytest.approx(6 * math.log10(4.5 / (5_500_033 + 0.5 * 9)) + math.log10(9.5 / (5_500_033 + 0.5 * 9)))
    assert got.score > got.base_score + 30


def test_distributions_sum_to_one(spark):
    rows = [(i, "x y z x y z x y q " * 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, model, n, v, _ = p.train(df.select("text"))
    words = [b"x", b"y", b"z", b"q", b""]
    for before in ([b" "], [b" ", b"x"], [b" ", b"x", b"y"], [b"x", b"y", b"z"], [b"z", b"x", b"y"]):
        total = 0.0
        for w in words:
            ids = p.np.array([model.numbers[k] for k in [*before, w]], dtype=p.np.int32)
            total += 10 ** model.score(ids)[-1]
        ids = p.np.array([model.numbers[k] for k in before] + [p.RARE], dtype=p.np.int32)
        total += 10 ** model.score(ids)[-1] * 0.5 / (n + 0.5 * (v + 1))
        assert total == pytest.approx(1.0)


def test_awkward_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "ÀB ab\x0bAB\x0cab x"), (4, "ÀB ab\x0bAB\x0cab x"), (None, "ab ab"), (7, "only here " * 5000)] + [(k, "ab cd ab cd") for k in range(8, 30)]
    hold(spark, rows)
    hold(spark, [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 1])  # nothing to learn from
    assert p.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ngrams_travel_in_few_bytes(spark):
    rng = random.Random(8)
    words = [f"w{int(400 * rng.random() ** 3)}" for _ in range(60_000)]
    batch = p.pa.RecordBatch.from_pydict({"text": [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)]})
    names = [b" ", b"", *sorted({w.encode() for w in words}, key=lambda w: -words.count(w.decode()))]
    numbers = dict(zip(names, range(1, len(names) + 1), strict=True))
    held = type("Held", (), {"value": (numbers, p.np.concatenate((p.np.zeros(1, p.np.uint64), p._hash(names))))})
    marks = type("Marks", (), {"value": p.np.full(2 << 14, 2**64 - 1, p.np.uint64)})
    out = list(p._count(held, marks, 20, 4)(iter([batch])))
    n = sum(sum(b.column("n").to_pylist()) for b in out)
    size = sum(len(x) for b in out for x in b.column("packed").to_pylist())
    assert size < 8 * n  # two codes alone are 16 bytes
    total = Counter()
    for part in range(4):
        table = p.pa.Table.from_batches(out)
        table = table.filter(p.pa.compute.equal(table.column("part"), part))
        for length, code, ctx, suf, c in zip(*p._total(held, 1)(table).to_pydict().values(), strict=True):
            assert (ctx * p._B + suf - code) % 2**64 == 0
            total[length] += c
    assert total == {k: (102 - k + 1) * 600 for k in (2, 3, 4)}
