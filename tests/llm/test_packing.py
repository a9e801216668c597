import functools
import random
import re
import zlib
from collections import defaultdict

import numpy as np

from lorequarry.llm import packing as p


def brute_cost(places, price, size):
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        best[j] = min(best[i] + size - (places[j] - places[i]) + price[j] for i in range(j) if best[i] is not None and places[j] - places[i] <= size)
    return best[-1]


def test_cuts_are_optimal():
    rng = random.Random(9)
    for _ in range(300):
        places, price, at = [0], [0], 0
        for _ in range(rng.randrange(1, 40)):
            at += rng.randrange(1, 8)
            places.append(at)
            price.append(rng.choice([0, 2, 8]))
        chosen = p.cuts(places, price, 16)
        cost, last = 0, 0
        for j in chosen:
            assert 0 < places[j] - places[last] <= 16
            cost += 16 - (places[j] - places[last]) + price[j]
            last = j
        assert last == len(places) - 1 and cost == brute_cost(places, price, 16)


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def hold(pieces, texts, encode):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, rows in by_doc.items():
        ids, at = encode(texts[doc_id]), 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = used = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= p.SIZE
        used += at
        padding += 0 if at & (at - 1) == 0 else p.SIZE - at
    return padding / used


def test_pack_edges(spark):
    rows = [(1, None), (2, ""), (3, "One. Two! Three?\n" * 4000), (4, "x" * 30_000), (5, "<|endoftext|> in text  \n\n tail"), (6, "no end " * 3000), (-7, "日本語。" * 900)]
    out = p.pack(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(2)).collect()
    hold(out, dict(rows), reference_ids)
    twice = p.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string").coalesce(1)).collect()
    assert [r.doc_id for r in twice] == [None, 1, 1] and [r.offset for r in twice] == [0, 2, 5]
    assert p.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_covers_every_id_with_little_padding(spark):
    from lorequarry.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert hold(QUERIES["op1_packing"](spark, sf).collect(), texts, reference_ids) < 0.005


def test_blocks_reopen_windows(spark, monkeypatch):
    encoder = p.Encoder()
    shard, rng, rows = p._Shard(0), random.Random(3), []
    texts = {i: "".join(rng.choice(["word ", "end. ", "\n"]) for _ in range(rng.randrange(3000))) for i in range(60)}
    for i, t in texts.items():
        ids = encoder.ids(t.encode())
        shard.add([i], [ids], *p.candidates([t.encode()], [ids], encoder.lengths))
        if shard.size > 20_000:
            rows += shard.settle(False)
    rows += shard.settle(True)
    names = [c.split()[0] for c in p.PIECES.split(", ")]
    from pyspark.sql import Row
    assert hold([Row(**dict(zip(names, r, strict=True))) for r in rows], texts, lambda t: encoder.ids(t.encode()).tolist()) < 0.01


def test_candidates_of_a_run_equal_a_search_by_expression():
    encoder, rng = p.Encoder(), random.Random(5)
    sentence = re.compile(rb"[.!?]+[\"')\]]*(?=\s)|\n")
    parts = [b"word", b" ", b".", b"!", b'"', b")", b"'", b"]", b"\n", b"\t", "日本".encode(), b"<|endoftext|>", b"\0", b"long words of a text that go on and on and on"]
    held = [b"".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(200)]
    ids = [encoder.ids(t) for t in held]
    want, at = {}, 0
    for text, own in zip(held, ids, strict=True):
        ends = np.cumsum(encoder.lengths[own[:-1]])
        known = {at: 0, at + len(own): 0} | {at + int(np.searchsorted(ends, m.end())) + 1: p.SENTENCE_PENALTY for m in sentence.finditer(text)}
        stops = sorted(known)
        want |= known
        for a, b in zip(stops, stops[1:], strict=False):
            want |= {k: p.WORD_PENALTY for k in range(a + p.GRID, b, p.GRID)}
        at += len(own)
    del want[0]
    places, price = p.candidates(held, ids, encoder.lengths)
    assert dict(zip(places.tolist(), price.tolist(), strict=True)) == want
