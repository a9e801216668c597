import random
import re

import corpus_pipeline
import pytest
from lorequarry.llm import packing, quality
from test_packing import hold
from test_quality import Brute, fold_of
from test_secret_scan import brute as secret_spans


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    words = low(text).split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def corpus():
    rng = random.Random(12)
    syllables = ["the", "ing", "ation", "er", "on", "re", "st", "an"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n // 9)) + "."
    docs = {k: prose(rng.randrange(150, 400)) for k in range(40)}
    labels = [(k, 1, 0) for k in range(36)]
    docs |= {50 + k: docs[k].upper() if k == 0 else docs[k] for k in range(6)}  # equal texts, one in capitals
    for k in range(10, 16):  # near copies: one word of hundreds differs
        words = docs[k].split(" ")
        words[len(words) // 2] = "changed"
        docs[60 + k] = " ".join(words)
    docs |= {80 + k: " ".join(f"{rng.choice('xqzjw')}{rng.choice('#$%')}{rng.randrange(999)}&&" for _ in range(120)) for k in range(5)}  # noise
    docs[25] += " password = hunter2hunter2 again"
    docs |= {90: docs[20][:300] + " password = hunter2hunter2 " + prose(200), 91: "", 92: None, 93: prose(3000)}
    return docs, labels


def expected(spark, docs, labels):
    folds = fold_of(spark, docs.values())
    models = [Brute([docs[k] for k, q, t in labels if q == 1 and t == 0 and folds[docs[k]] == f]) for f in (0, 1)]
    score = lambda t: (lambda logp, n: -logp / n if n else None)(*models[1 - folds[t or ""]].logp(t or ""))
    trusted = sorted(score(docs[k]) for k, _, _ in labels)
    limit = trusted[-1] + quality.MARGIN  # fewer than two hundred trusted texts: the quantile 0.995 is the largest
    kept = {k: t for k, t in docs.items() if score(t) is None or score(t) <= limit + 1e-3}
    groups = {}
    for k, t in kept.items():
        groups.setdefault(low(t), []).append(k)
    kept = {max(g): kept[max(g)] for g in groups.values()}
    sets, out = {k: shingles(t) for k, t in kept.items()}, {}
    for k in sorted(kept):
        if not any(len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) for j in out):
            out[k] = kept[k]
    for k, t in out.items():
        spans = [s.split(":") for s in secret_spans(t or "")]
        for kind, a, b in reversed(spans):
            t = f"{t[: int(a)]}[secret:{kind}]{t[int(b) :]}"
        out[k] = t
    return kept, out


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels = corpus()
    rows = [(k, t, "en", "s", len(t or ""), "extra") for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    _, final = expected(spark, docs, labels)
    assert not any(80 <= k < 90 for k in final) and any("[secret:assign]" in (t or "") for t in final.values())
    encoder = packing.Encoder()
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    hold(pieces, final, lambda t: encoder.ids((t or "").encode()).tolist())


def test_stages_keep_columns_and_bear_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        if k < 4:
            assert out.columns == empty.columns


@pytest.mark.parametrize("text", ["token=abcdef1 and " + "0a" * 14, "x"])
def test_redaction_of_brute_spans(text):
    from lorequarry.llm import secret_scan

    out = secret_scan.redacted(text, secret_scan.automaton())
    assert len(re.findall(r"\[secret:", out)) == len(secret_spans(text))
