import os
from datetime import datetime, timedelta, timezone

import pytest

from lorequarry.streaming import tail as t


def batches(spark, log, base, **options):
    """Reads what is there now; a second call with the same base goes on from the checkpoint."""
    spark.dataSource.register(t.LogTail)
    out = f"{base}/out"
    df = spark.readStream.format("log_tail").options(**options).load(str(log))
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("line string, signature string, offset long").parquet(out).collect() if os.path.isdir(out) else []
    return sorted(r.line for r in rows)


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_partial_lines_rotation_and_truncation(spark, tmp_path, size):
    log, base = tmp_path / "a.jsonl", tmp_path / "run"
    log.write_text("one\ntwo\npart")
    assert batches(spark, log, base, range_bytes=size) == ["one", "two"]
    with log.open("a") as f:
        f.write("ial é\n\nlast line of the old file\n")
    os.rename(log, tmp_path / "a.jsonl.1")  # rotated before it was read to its end
    log.write_text("new first\nnew second\nwait")
    want = sorted(["one", "two", "partial é", "", "last line of the old file", "new first", "new second"])
    assert batches(spark, log, base, range_bytes=size) == want
    log.write_text("cut\n")  # truncated: another first line
    want = sorted([*want, "cut"])
    assert batches(spark, log, base, range_bytes=size) == want
    with log.open("a") as f:
        f.write("more\n")
    assert batches(spark, log, base, range_bytes=size) == sorted([*want, "more"])


def test_a_shorter_file_with_the_same_first_line_starts_again(tmp_path):
    log = tmp_path / "b"
    log.write_text("head\n" + "x\n" * 10)
    tail = t._Tail(str(log), 1 << 20)
    old = tail.latestOffset()
    log.write_text("head\ny\n")
    parts = tail.partitions(old, tail.latestOffset())
    assert [r[0] for p in parts for r in tail.read(p)] == ["head", "y"]
    assert t._Tail(str(tmp_path / "none"), 5).latestOffset() == {"signature": "", "offset": 0}


def test_a_change_starts_the_quiet_period_again(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = lambda ms: start + timedelta(milliseconds=ms)
    src = str(tmp_path / "in")
    schema = "key string, path string, ts timestamp"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    base = int(start.timestamp() * 1000)

    def run():
        got = []
        keep = lambda df, _: got.extend((r.key, r.first - base, r["last"] - base, r.n, sorted(r.paths)) for r in df.collect())
        t.debounce(spark.readStream.schema(schema).parquet(src)).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
        return sorted(got)

    put([("a", "x", at(0)), ("a", "y", at(1000)), ("a", "x", at(2400)), ("b", "z", at(100))])
    assert run() == [("b", 100, 100, 1, ["z"])]  # the watermark is at 2400: only b has been quiet for long enough
    put([("a", "w", at(3800))])  # 1400 ms after the last change: the period starts again
    assert run() == []
    put([("c", "v", at(9000))])
    assert run() == [("a", 0, 3800, 4, ["w", "x", "y"])]
    assert sorted((r.key, r.first - base, r["last"] - base, r.n) for r in t.debounced(spark.read.schema(schema).parquet(src)).collect()) == [("a", 0, 3800, 4), ("b", 100, 100, 1), ("c", 9000, 9000, 1)]
