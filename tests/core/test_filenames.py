from pyspark.sql import functions as F

from lorequarry.operators import filenames as N


def test_names_that_condemn(spark):
    want = {
        ".env": "dotenv", "a/.env.local": "dotenv", "prod.env": "dotenv", ".env.example": None, "a/x.sample": None, "cert.pem": "pem", "a/b/server.key": "private-key", "id_rsa": "ssh-private-key",
        "home/.ssh/config": "ssh-private-key", ".ssh": None, "id_rsa.pub": "ssh-private-key", "credentials": "credentials", "credentials.json": "credentials", "src/credentials.py": None, "secrets.yaml": "secrets",
        "my_secrets_here.txt": "secrets", "tokens.py": None, "tokens.json": "tokens", "api_token.txt": "tokens", "auth_token.go": None, "refresh-tokens.yaml": "tokens", "docs/tokens.md": None,
        "tokens.PY": None, "password.txt": "password-file", ".htpasswd": "password-file", ".netrc": "shell-credentials", ".aws/credentials": "credentials", ".aws/config": "cloud-credentials",
        "x/.docker/config.json": "cloud-credentials", "gcp-prod.json": "cloud-credentials", "v.kdbx": "password-manager", "main.tfstate": "terraform-state", "src/app.py": None, "": None, "a\\b\\.env": "dotenv",
        "secrets/plain.txt": "secrets", "credentials.example.json": None, "environment.ts": None, None: None,
    }
    rows = spark.createDataFrame([(p,) for p in want], "p string").select("p", N.finding(F.col("p")).alias("f"), N.finding(F.col("p"), {"dotenv"}).alias("g"))
    got = rows.collect()
    assert {r.p: r.f and r.f.rule for r in got} == want
    assert {r.f.severity for r in got if r.f and r.f.rule == "terraform-state"} == {3}
    assert all((r.g and r.g.rule) == (None if r.f and r.f.rule == "dotenv" else r.f and r.f.rule) for r in got)


def test_context_digests():
    base = N.context(N.DENIED, {"policy": "balanced", "disabled": {"b", "a"}}, {"rules": 1})
    assert base == N.context(N.DENIED, {"disabled": {"a", "b"}, "policy": "balanced"}, {"rules": 1}) and len(base) == 64
    others = [N.context(N.DENIED[1:], {"policy": "balanced", "disabled": {"b", "a"}}, {"rules": 1}), N.context(N.DENIED, {"policy": "strict", "disabled": {"b", "a"}}, {"rules": 1}), N.context(N.DENIED, {"policy": "balanced", "disabled": {"b", "a"}}, {"rules": 2})]
    assert len({base, *others}) == 4


def test_verdicts_hold_under_the_same_context_only(spark):
    kept = spark.createDataFrame([("a", 1, 10, "now", "clean"), ("a", 1, 10, "now", "block"), ("b", 1, 10, "old", "clean"), ("c", 2, 10, "now", "clean"), ("d", 1, 10, None, "clean")], "path string, size long, modified long, context string, verdict string")
    files = spark.createDataFrame([("a", 1, 10, "x"), ("b", 1, 10, "x"), ("c", 1, 10, "x"), ("d", 1, 10, "x"), ("e", None, None, "x")], "path string, size long, modified long, verdict string")
    assert {(r.path, r.verdict, r.reused) for r in N.reusable(files, kept, "now").collect()} == {("a", "block", True), ("b", None, False), ("c", None, False), ("d", None, False), ("e", None, False)}
    assert not N.reusable(files, kept, "now", full=True).where("reused").collect() and not N.reusable(files.limit(0), kept, "now").collect()
