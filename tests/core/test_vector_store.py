import os

from lorequarry.sources import vectors as v


def test_round_trip_damage_and_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(v, "PART", 3)
    path = str(tmp_path / "store")
    rows = [(f"{i * 7 % 256:02x}" + f"{i:030x}", float(i) / 8, -1.0, [i % 256, 255, 0]) for i in range(60)]
    odd = [("zz", 1.0, 0.0, [1, 2, 3]), (None, 1.0, 0.0, [1]), ("f" * 32, float("nan"), 0.0, [1, 2, 3]), (rows[0][0].upper(), 9.0, 9.0, [255, 255, 255]), ("e" * 32, 1.0, 0.0, [7])]
    df = spark.createDataFrame(rows + odd, "id string, scale double, offset double, codes array<int>").repartition(5)
    first = {r.file for r in v.write_store(df, path, "m1", 3).collect()}
    files = {f for f in os.listdir(path) if f.endswith(".i8")}
    assert first == files and not [f for f in os.listdir(path) if f.startswith(".shard")]
    got, report = v.read_store(spark, path, "m1", 3)
    want = sorted([(i, s, o, c) for i, s, o, c in rows] + [("e" * 32, 1.0, 0.0, [7, 0, 0])])
    assert sorted((r.id, r.scale, r.offset, r.codes) for r in got.collect()) == want
    said = report.collect()
    assert {r.status for r in said} == {"ok"} and sum(r.rows for r in said) == 61 and sum(r.skipped for r in said) == 1
    bad, lost = sorted(files)[:2]
    (tmp_path / "store" / bad).write_bytes(b"spoilt")
    os.remove(tmp_path / "store" / lost)
    got, report = v.read_store(spark, path, "m1", 3)
    status = {r.file: r.status for r in report.collect()}
    assert status.pop(bad) == "damaged" and status.pop(lost) == "missing" and set(status.values()) == {"ok"}
    assert 0 < got.count() < 61
    got, report = v.read_store(spark, path, "m2", 3)
    assert got.count() == 0 and {r.status for r in report.collect()} == {"another model"}
    assert v.write_store(df.limit(0), str(tmp_path / "none"), "m", 3).count() == 0
