import hashlib
import os

import pytest

from lorequarry.llm import warc as w


def brute(rows):
    out, first = [], {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= w.LEAST_REVISIT and i is not None:
            first[data] = min(i, first.get(data, i))
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(data) if i is not None and first.get(data, i) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


ROWS = [(5, "http://a/ b\r\nX: y", "x" * 100), (3, None, "x" * 100), (9, "http://c", "x" * 99), (10, "http://d", "x" * 99), (7, "u", None), (8, "", ""), (None, "n", "x" * 100), (3, "again", "x" * 100), (40, "l", "é" * 700_000), (41, "l", "é" * 700_000)] + [
    (100 + k, "h", f"<p>{k}</p>\r\n\r\nWARC/1.1\r\n" * 9) for k in range(300)
]


def test_round_trip_equals_brute_force_and_files_are_the_same_each_time(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, shard int")
    sums = []
    for k, parts in enumerate((1, 5)):
        path = f"{tmp_path}/{k}"
        manifest = w.write(df.repartition(parts), path, shard_bytes=60_000, file_bytes=2000)
        assert sorted((tuple(r) for r in w.read(manifest, path).collect()), key=str) == brute(ROWS)
        rows = manifest.collect()
        assert len({r.shard for r in rows}) > 3 and len(rows) > len({r.shard for r in rows})
        assert sorted(os.listdir(path)) == sorted([r.file for r in rows] + ["_manifest"])
        sums.append({r.file: r.sha256 for r in rows})
    assert sums[0] == sums[1]


def test_empty_table_and_damage(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert w.digest(spark, df).count() == 0
    good = w.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert w.parse(good)[1] == 7
    with pytest.raises(ValueError):
        w.parse(good.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"))


def test_far_off_ids_and_many_rows_of_one_id_leave_shards_small(spark, tmp_path):
    import random

    rng = random.Random(7)
    html = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5000))
    rows = [(k, "u", html()) for k in range(600)] + [(1 << 60, "far", html()), (-(1 << 63), "low", html()), ((1 << 63) - 1, "high", html())] + [(300, f"again {k}", html()) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    firsts = []
    for k, parts in enumerate((2, 7)):
        manifest = w.write(df.repartition(parts), f"{tmp_path}/{k}", shard_bytes=100_000)
        by = {}
        for r in manifest.collect():
            by[r.shard] = by.get(r.shard, 0) + r.records
        assert sum(by.values()) == len(rows) and len(by) > 45 and max(by.values()) * 5500 <= 100_000 + 2 * 5500
        read = w.read(manifest, f"{tmp_path}/{k}")
        assert read.rdd.getNumPartitions() == manifest.count()
        assert sorted((tuple(r) for r in read.collect()), key=str) == brute(rows)
        firsts.append(sorted(r.sha256 for r in manifest.collect()))
    assert firsts[0] == firsts[1]
