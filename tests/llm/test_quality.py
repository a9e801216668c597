import math
from collections import Counter, defaultdict

import pytest

from lorequarry.llm import quality as q


class Brute:
    """Interpolated modified Kneser-Ney from its definition, over symbol tuples; None is a word's boundary."""

    def __init__(self, texts):
        raw = Counter()
        for t in texts:
            for w in t.split():
                s = [None, *w, None]
                for i in range(1, len(s)):
                    raw[tuple(s[max(0, i + 1 - q.ORDER) : i + 1])] += 1
        self.levels = {}
        for n in range(q.ORDER, 0, -1):
            c = Counter({g: k for g, k in raw.items() if len(g) == n})
            for g in self.levels.get(n + 1, ()):
                c[g[1:]] += 1
            self.levels[n] = c
        self.stats = {}
        for n, c in self.levels.items():
            of = Counter(c.values())
            y = of[1] / max(of[1] + 2 * of[2], 1)
            d = [max(0.0, min(k, k - (k + 1) * y * of[k + 1] / max(of[k], 1))) for k in (1, 2, 3)]
            by = defaultdict(list)
            for g, k in c.items():
                by[g[:-1]].append(k)
            self.stats[n] = (d, {x: (sum(ks), max(sum(d[min(k, 3) - 1] for k in ks) / sum(ks), 1e-6)) for x, ks in by.items()})

    def p(self, g):
        if not g:
            return 1 / q.ALPHABET
        d, contexts = self.stats[len(g)]
        lower = self.p(g[1:])
        if g[:-1] not in contexts:
            return lower
        total, keep = contexts[g[:-1]]
        k = self.levels[len(g)].get(g, 0)
        return (k - d[min(k, 3) - 1] if k else 0) / total + keep * lower

    def logp(self, text):
        out = n = 0
        for w in text.split():
            s = [None, *w, None]
            for i in range(1, len(s)):
                out += math.log(self.p(tuple(s[max(0, i + 1 - q.ORDER) : i + 1])))
                n += 1
        return out, n


def fold_of(spark, texts):
    """Fold of each text, by the same hash."""
    df = spark.createDataFrame([(t or "",) for t in texts], "t string")
    return {r.t: r.f for r in df.select("t", q.F.pmod(q.F.xxhash64("t"), q.F.lit(q.FOLDS)).alias("f")).collect()}


@pytest.mark.parametrize("rows", [1 << 20, 40])
def test_scores_equal_the_definition_in_one_shard_or_many(spark, monkeypatch, rows):
    monkeypatch.setattr(q, "SHARD_ROWS", rows)
    train = {"en": ["the cat sat on the mat", "a cat and a hat", "the the then there", "hat on the mat then", "cats sat there", "that then"], "de": ["über die straße", "die katze saß"]}
    docs, labels, k = [], [], 0
    for lang, ts in train.items():
        for t in ts:
            docs.append((k, t, lang))
            labels.append((k, 1, 0))
            k += 1
    extra = ["the mat", "", None, "xyz###", "cat " * 2000, "日本 語", "there", "there"]
    docs += [(k + i, t, "en") for i, t in enumerate(extra)] + [(99, "quoi", "fr"), (None, "the", None), (99, "quoi", "fr")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, lang string, hash int")
    got = {(r.id, r.lang): r for r in q.scores(df, spark.createDataFrame([*labels, labels[0]], "doc_id long, quality int, toxic int")).collect()}
    folds = fold_of(spark, [t for _, t, _ in docs])
    models = {(lang, f): Brute([t for t in ts if folds[t] == f]) for lang, ts in train.items() for f in (0, 1) if any(folds[t] == f for t in ts)}
    for i, t, lang in docs:
        r = got[(i, lang or "")]
        model = models.get((lang, 1 - folds[t or ""]))
        if model is None or not (t or "").split():
            assert r.perplexity is None
            continue
        logp, n = model.logp(t)
        assert r.n == n and r.logp == pytest.approx(logp, rel=1e-4)
    out = q.keep(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == df.columns and out.where("doc_id = 99").count() == 2
    assert q.classify(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_classifier_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = labels.where("pmod(xxhash64(doc_id), 2) = 0"), labels.where("pmod(xxhash64(doc_id), 2) = 1")
    judged = q.judge(docs, fit).join(held, held.doc_id == q.F.col("id"))
    rows = {(r.quality, r.keep): r["count"] for r in judged.groupBy("quality", "keep").count().collect()}
    print(rows)
    assert rows[1, True] / (rows[1, True] + rows.get((1, False), 0)) > 0.97
    assert rows[0, False] / (rows[0, True] + rows[0, False]) > 0.3
