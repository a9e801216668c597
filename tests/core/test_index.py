import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

from lorequarry.operators import index as ix

LETTERS = re.compile(r"[^\W_]+")


def split(text):
    low = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c)).lower()
    return LETTERS.findall(low)


def brute(docs, queries, weights):
    """docs: id -> {field: text}; queries: id -> [(words, prefix)]."""
    toks = {i: {f: split(t) for f, t in d.items()} for i, d in docs.items()}
    dl = {i: sum(map(len, d.values())) for i, d in toks.items()}
    avg = sum(dl.values()) / max(len(dl), 1)

    def times(i, words, prefix):
        total = 0.0
        for f, ts in toks[i].items():
            for p in range(len(ts) - len(words) + 1):
                got = ts[p : p + len(words)]
                if got[:-1] == words[:-1] and (got[-1].startswith(words[-1]) if prefix else got[-1] == words[-1]):
                    total += weights.get(f, 1.0)
        return total

    out = defaultdict(float)
    for q, units in queries.items():
        for words, prefix in units:
            tf = {i: t for i in toks if (t := times(i, words, prefix))}
            idf = max(math.log((len(toks) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6) if tf else 0
            for i, t in tf.items():
                out[q, i] += idf * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * dl[i] / avg))
    return {k: round(v, 4) for k, v in out.items()}


def scores(index, spark, queries, **more):
    df = spark.createDataFrame(queries, "query_id long, text string")
    return {(r.query_id, r.doc_id): round(r.score, 4) for r in index.scores(df, **more).collect()}


def test_ranking_with_phrases_prefixes_fields_and_changes(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["auth", "service", "Serviço", "token", "tokens", "naïve", "maybe", "login", "log", "logs"]
    docs = {i: {"text": " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))), "title": " ".join(rng.choices(vocabulary, k=2))} for i in range(60)}
    frame = lambda d: spark.createDataFrame([(i, x["text"], x["title"]) for i, x in d.items()], "doc_id long, text string, title string")
    index = ix.Index(spark, str(tmp_path / "index"), ("text", "title"), buckets=4)
    index.apply(frame(docs))
    weights = {"title": 4.0}
    asked = [(1, "AuthService naive"), (2, "auth_service LOG"), (3, "???"), (4, None), (5, "maybe maybe")]
    units = {1: [(["authservice"], False), (["auth"], False), (["service"], False), (["naive"], True)], 2: [(["auth", "service"], False), (["auth"], False), (["service"], False), (["log"], True)], 5: [(["maybe"], True)]}
    assert scores(index, spark, asked, weights=weights) == brute(docs, units, weights)
    # a second batch changes, deletes and adds; only it is tokenised, and merging changes nothing
    changed = {3: {"text": "auth service login", "title": "new"}, 99: {"text": "naïveté", "title": ""}}
    index.apply(frame(changed), spark.createDataFrame([(5,), (6,), (1000,)], "doc_id long"))
    now = {i: d for i, d in (docs | changed).items() if i not in (5, 6)}
    want = brute(now, units, weights)
    assert scores(index, spark, asked, weights=weights) == want
    index.merge()
    assert index.segments()[1] == [3] and scores(index, spark, asked, weights=weights) == want
    raw = [(1, '"auth service" OR log*'), (2, '"unbalanced'), (3, "OR OR"), (4, "login OR"), (5, '"service log"*')]
    raw_units = {1: [(["auth", "service"], False), (["log"], True)], 5: [(["service", "log"], True)]}
    got = scores(index, spark, raw, raw=True)
    assert {k: v for k, v in got.items() if k[0] in (1, 5)} == brute(now, raw_units, {}) and not {k[0] for k in got} & {2, 4}


def test_awkward_batches(spark, tmp_path):
    index = ix.Index(spark, str(tmp_path / "i"))
    assert scores(index, spark, [(1, "a word")]) == {}
    index.apply(spark.createDataFrame([(1, None), (2, ""), (None, "word"), (3, "word"), (3, "word zebra")], "doc_id long, text string"))
    assert set(scores(index, spark, [(1, "word")])) == {(1, 3)} and set(scores(index, spark, [(1, "zebra")])) == {(1, 3)}
    index.apply(None, spark.createDataFrame([(3,)], "doc_id long"))
    assert scores(index, spark, [(1, "word")]) == {}
    assert Counter(index.segments()[1]) == Counter([1, 2])


def test_a_search_reads_only_asked_buckets(spark, tmp_path):
    index = ix.Index(spark, str(tmp_path / "i"), buckets=16)
    index.apply(spark.createDataFrame([(i, f"w{i} common") for i in range(200)], "doc_id long, text string"))
    plan = index.postings([1], [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_postings_meet_in_their_documents_and_phrases_count_repeats(spark, tmp_path, monkeypatch):
    lists = ix.pa.array([["b", "a", "b"], [], ["c"] * 4, ["a"]], ix.pa.list_(ix.pa.string()))
    monkeypatch.setattr(ix, "RUN_TOKENS", 3)
    batch = ix.pa.RecordBatch.from_arrays([ix.pa.array([7, 8, 9, 10]), lists, lists], ["doc_id", "x", "y"])
    rows = [tuple(r.values()) for out in ix._postings(("x", "y"))([batch.slice(0, 2), batch.slice(2)]) for r in out.to_pylist()]
    want = [(t, d, f, p, len(p)) for t, d, p in [("b", 7, [0, 2]), ("a", 7, [1]), ("c", 9, [0, 1, 2, 3]), ("a", 10, [0])] for f in "xy"]
    assert sorted(rows) == sorted(want)
    monkeypatch.setattr(ix, "FILE_DOCS", 5)
    docs = {i: {"text": "la la la de la " * (i % 3) + f"la de w{i % 4}"} for i in range(40)}
    index = ix.Index(spark, str(tmp_path / "i"), buckets=2)
    index.apply(spark.createDataFrame([(i, d["text"]) for i, d in docs.items()], "doc_id long, text string"))
    asked = {1: [(["la", "la"], False)], 2: [(["la", "de", "la"], False)], 3: [(["de", "w"], True)]}
    said = [(q, " OR ".join(f'"{" ".join(w)}"' + "*" * pre for w, pre in units)) for q, units in asked.items()]
    assert scores(index, spark, said, raw=True) == brute(docs, asked, {})


def test_words_looked_up_in_tasks_score_as_joined_ones_and_texts_do_not_move(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["na", "naïve", "nah", "lake", "la", "laken", "𝒜b", "𝒜bc"]
    docs = {i: {"text": " ".join(rng.choices(vocabulary, k=rng.randrange(0, 25))), "title": rng.choice(vocabulary)} for i in range(120)}
    frame = spark.createDataFrame([(i, d["text"], d["title"]) for i, d in docs.items()], "doc_id long, text string, title string").repartition(6)
    monkeypatch.setattr(ix, "TASK_DOCS", 20)
    monkeypatch.setattr(ix, "MET", 50)
    index = ix.Index(spark, str(tmp_path / "i"), ("text", "title"), buckets=2)
    assert "Exchange" not in index._spread(frame.where("doc_id >= 0"))._jdf.queryExecution().executedPlan().toString().split("Exchange RoundRobin")[0]
    index.apply(frame)
    asked = [(1, 'na* OR "la lake"'), (2, "la* OR naive"), (3, '"lake la"* OR 𝒜b*'), (4, '"na"'), (5, "absent"), (6, '"absent la"')]
    units = {1: [(["na"], True), (["la", "lake"], False)], 2: [(["la"], True), (["naive"], False)], 3: [(["lake", "la"], True), (["𝒜b"], True)], 4: [(["na"], False)]}
    want, weights = brute(docs, units, {"title": 2.0}), {"title": 2.0}
    queries = spark.createDataFrame(asked, "query_id long, text string")
    some = spark.createDataFrame([(i,) for i in range(0, 120, 7)], "doc_id long")
    for most in (ix.BROADCAST_TERMS, 0):
        monkeypatch.setattr(ix, "BROADCAST_TERMS", most)
        whole = {(r.query_id, r.doc_id): r.score for r in index.scores(queries, True, weights).collect()}
        assert {k: round(v, 4) for k, v in whole.items()} == want
        best = {(q, d) for q in units for _, d in sorted((-s, d) for (p, d), s in whole.items() if p == q)[:3]}
        assert {(r.query_id, r.doc_id) for r in index.search(queries, 3, True, weights).collect()} == best
        assert {(r.query_id, r.doc_id) for r in index.search(queries, 200, True, weights, some).collect()} == {k for k in want if k[1] % 7 == 0}


def test_a_search_moves_little_of_what_it_reads(spark, tmp_path):
    """Prefixes of many terms moved all postings twice, with their positions; now only what fits moves, and lengths."""
    index = ix.Index(spark, str(tmp_path / "i"), buckets=2)
    index.apply(spark.createDataFrame([(i, " ".join(f"w{i * 7 % 97}x{k}" for k in range(60))) for i in range(200)], "doc_id long, text string"))
    plan = index.scores(spark.createDataFrame([(1, "a w3")], "query_id long, text string"), most=5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "positions" not in plan
