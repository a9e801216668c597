import hashlib
import random
import zlib

import numpy as np

from lorequarry.llm import pieces as p


def test_units_equal_the_library(spark):
    codec, rng = p.Codec(), random.Random(2)
    parts = ["the", " ", "  ", "ation", "é", "日本", "𝔘", "\n", "\t", "x" * 40, "ab", "▁", "0", "!!", "Th", "\x00".replace("\x00", "~")]
    sample = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(1500)] + ["z" * 3000, "the" * 900, "é" * 400]
    for text in sample:
        units = p._UNIT.findall(codec.normalised(text))
        got = [i for x in codec.encode_units(units) for i in x.tolist()]
        assert got == codec.sp.encode(text), text
        assert codec.decode(np.array(got)) == codec.sp.decode(got), text


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (4, "a b"), (4, "a b"), (None, "c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    ids = p.encode(df)
    assert [r.n_ids for r in ids.where("doc_id <= 2").collect()] == [0, 0] and ids.count() == 6
    assert sorted((r.doc_id or 0, r.text) for r in p.decode(ids).collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert p.digest(df.limit(0)).count() == 0


def test_query_equals_the_library(spark):
    from lorequarry.llm.queries import QUERIES

    sf, codec = "/root/testdata/sf0.01", p.Codec()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_sentencepiece"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        ids = codec.sp.encode(text[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(codec.sp.decode(ids).encode()).hexdigest() and r.round_trip
