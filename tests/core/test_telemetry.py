import glob
from datetime import date, datetime

from lorequarry.sources import telemetry as L

CALLS = "ts timestamp, tool string, ms double, project string, ok boolean, error string, degraded boolean, text string, query string"


def calls(spark, rows):
    return spark.createDataFrame([(datetime.fromisoformat(t), *r) for t, *r in rows], CALLS)


ROWS = [
    ("2024-01-01 10:00:00.123456", "search", 5.0, "p", True, None, None, "some words", "secret query"),
    ("2024-01-01 11:00:00", "search", 15.0, "p", False, "not_found", None, None, "q"),
    ("2024-01-02 11:00:00", "search", 25.0, "p", False, "it said: secret query", True, "x", "q"),
    ("2024-01-03 11:00:00", "search", 30.0, None, None, "ignored", False, "", "q"),
    ("2024-02-03 11:00:00", "get", None, None, True, None, False, "", "q"),
    ("2024-02-03 11:00:00", None, 1.0, None, True, None, False, "", "q"),
]


def test_lines_hold_counts_and_codes_only(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = L.entries(calls(spark, ROWS), ("not_found",))
    L.append(lines, path, 0)
    said = "".join(open(f).read() for f in glob.glob(f"{path}/*/*/*.json"))
    assert "secret" not in said and "words" not in said
    got = L.read(spark, path).orderBy("ts").collect()
    assert [(r.tool, r.ok, r.err_code, r.degraded, r.resp_chars, r.resp_tokens) for r in got] == [
        ("search", True, None, None, 10, 3), ("search", False, "not_found", None, 0, 0), ("search", False, "unknown", True, 1, 1), ("search", None, None, None, 0, 0), ("get", True, None, None, 0, 0),
    ]
    assert got[0].ts == datetime(2024, 1, 1, 10, 0, 0, 123456) and str(got[0].day) == "2024-01-01"
    assert L.read(spark, path, date(2024, 1, 3)).count() == 2


def test_a_batch_written_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = L.entries(calls(spark, ROWS))
    for batch in (0, 1, 1):
        L.append(lines, path, batch)
    assert L.read(spark, path).count() == 10
    L.append(lines.limit(0), path, 2)
    assert L.read(spark, path).count() == 10


def test_files_are_bounded_and_old_days_go(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    monkeypatch.setattr(L, "LINES", 3)
    L.append(L.entries(calls(spark, ROWS[:1] * 10 + ROWS)).coalesce(1), path, 0)
    assert len(glob.glob(f"{path}/day=2024-01-01/*/*.json")) == 4
    assert L.expire(spark, path, date(2024, 2, 4), 0) == [] and L.expire(spark, str(tmp_path / "none"), date(2024, 2, 4)) == []
    assert L.expire(spark, path, date(2024, 2, 2), 30) == ["2024-01-01", "2024-01-02"]
    assert L.read(spark, path).count() == 2
    (tmp_path / "log/day=2024-02-03").joinpath("batch=9").mkdir()
    (tmp_path / "log/day=2024-02-03/batch=9/part.json").write_text('{"broken\n')
    assert L.read(spark, path).count() == 2


def test_statistics_count_known_outcomes(spark, tmp_path):
    got = {r.tool: r for r in L.tool_statistics(L.entries(calls(spark, ROWS))).collect()}
    r = got["search"]
    assert set(got) == {"search"} and (r.calls, r.p50, r.known, r.errors, round(r.error_rate, 4)) == (4, 20.0, 3, 2, 0.6667)
    assert abs(r.p95 - 29.25) < 1e-9
    unknown = L.tool_statistics(L.entries(calls(spark, ROWS[3:4]))).first()
    assert (unknown.known, unknown.error_rate) == (0, None)
    assert L.read(spark, str(tmp_path / "nothing")).count() == 0


def test_a_stream_of_calls(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "log")
    calls(spark, ROWS).write.parquet(src)
    stream = spark.readStream.schema(CALLS).parquet(src)
    for _ in range(2):
        L.sink(stream, path, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert L.read(spark, path).count() == 5
