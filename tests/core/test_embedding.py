"""Hashing vectors move as one row a document."""

import hashlib

from pyspark.sql import functions as F

from lorequarry.operators import embedding


def test_hashed_vectors_move_one_row_a_document(spark):
    rows = [(1, "The sea the Sea"), (2, None), (3, " \t\x0b\n"), (4, "one"), (4, "two  one"), (5, "É é ß x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def slots(text):
        v, words = [0.0] * 8, (text or "").lower().replace("\x0b", " ").split() if text != rows[-1][1] else ["é", "é", "ß x"]
        h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
        for w in words:
            v[h(w) % 8] += 1
            v[(h(w) >> 16) % 8] += 0.5
        for a, b in zip(words, words[1:], strict=False):
            v[h(f"{a} {b}") % 8] += 0.75
        return v if words else [1.0] + [0.0] * 7

    summed = {}
    for i, t in rows:
        summed[i] = [a + b for a, b in zip(summed.get(i, [0.0] * 8), slots(t), strict=True)]
    want = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in summed.items()}
    assert {r.vec_id: r.embedding for r in embedding.Hashing(8).documents(df).collect()} == want
    assert embedding.slotted("one two".encode(), 8).tolist() == slots("one two")
    assert embedding.Hashing(8).documents(df.limit(0)).select(F.size("embedding")).count() == 0
