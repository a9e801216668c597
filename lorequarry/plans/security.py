"""Security queries. Small corpora match none of the content rules, so every seventh document gets one assignment derived from its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorequarry.operators import filenames, ignore
from lorequarry.operators import security as S
from lorequarry.plans.registry import both, query
from lorequarry.session import read_table

both("placeholder_filter", "SELECT doc_id, v IN ('changeme', 'example', 'test', 'none') OR v LIKE '%your-%' AS placeholder FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'example' WHEN 1 THEN 'your-key' WHEN 2 THEN 'none' ELSE source END AS v FROM {documents}) t")
both("verdict_cache", "SELECT a.doc_id, a.n_chars = b.n_chars AS reusable FROM {documents} a JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS n_chars FROM {documents}) b ON b.doc_id = a.doc_id")
both("filename_deny", """SELECT doc_id, CASE WHEN p LIKE '%.py' THEN 'allow' WHEN p LIKE '%.env' OR p LIKE '%.pem' OR p LIKE '%id_rsa%' THEN 'block' ELSE 'allow' END AS verdict
    FROM (SELECT doc_id, source || CASE doc_id % 5 WHEN 0 THEN '/.env' WHEN 1 THEN '/key.pem' WHEN 2 THEN '/tokens.py' WHEN 3 THEN '/id_rsa' ELSE '/a.md' END AS p FROM {documents}) t""")
both("ignore_rules", """WITH rules AS (SELECT 1 AS place, 'src1' AS prefix, true AS drop_ UNION ALL SELECT 2, 'src17', false UNION ALL SELECT 3, 'src5', true)
    SELECT doc_id, coalesce(max_by(drop_, place), false) AS ignored FROM {documents} LEFT JOIN rules ON substr(source, 1, CAST(length(prefix) AS INT)) = prefix GROUP BY doc_id""")


IGNORE_FILES = {
    ".gitignore": "*.log\n/src1/\nsrc2/**\n!src2/en/*.md\n**/de/*.py\n",
    "src3/.gitignore": "fr/\n!*.log\n",
    ".localignore": "!src5/**/*.log\n",
}
_IGNORE_SQL = """p AS (SELECT source AS s, lang AS l, CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'log' WHEN 2 THEN 'py' ELSE 'tmp' END AS e, doc_id FROM documents),
    q AS (SELECT *, s || '/' || l || '/' || doc_id || '.' || e AS path, e = 'log' OR s = 'src1' OR (s = 'src2' AND NOT (l = 'en' AND e = 'md')) OR (l = 'de' AND e = 'py') AS root FROM p),
    d AS (SELECT path, s, l, CASE WHEN s = 'src5' AND e = 'log' THEN false WHEN s = 'src3' AND l = 'fr' AND e <> 'log' THEN true WHEN s = 'src3' AND e = 'log' THEN false ELSE root OR e = 'tmp' END AS ignored,
                 CASE WHEN s = 'src5' AND e = 'log' THEN '.localignore (negation)' WHEN s = 'src3' AND l = 'fr' AND e <> 'log' THEN 'src3/.gitignore' WHEN s = 'src3' AND e = 'log' THEN 'src3/.gitignore (negation)'
                      WHEN root THEN '.gitignore' WHEN e = 'tmp' THEN 'builtin' END AS source FROM q)"""
_PRUNED = "s = 'src1' OR (s = 'src2' AND l <> 'en') OR (s = 'src3' AND l = 'fr')"


def _tree(spark, sf_dir):
    """A path for each document, the given rules, and ignore files at the root and in one folder."""
    ext = F.element_at(F.array(*map(F.lit, ("md", "log", "py", "tmp"))), (F.col("doc_id") % 4 + 1).cast("int"))
    paths = read_table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat_ws(".", "doc_id", ext)).alias("path"))
    return paths, ignore.configured(spark, ["*.tmp"], "builtin", 0), spark.createDataFrame(list(IGNORE_FILES.items()), "path string, text string")


IGNORE_KINDS = {".gitignore": 1, ".dockerignore": 2, ".localignore": 3}


@query("ignore_decisions", f"WITH {_IGNORE_SQL} SELECT path, ignored, source FROM d")
def ignore_decisions(spark, sf_dir):
    """Every path against anchored, folder, double-star and negated rules of nested files, with the source that decided."""
    paths, given, files = _tree(spark, sf_dir)
    return ignore.decide(paths, given.unionByName(ignore.found(files, IGNORE_KINDS)))


@query("ignore_pruned", f"WITH {_IGNORE_SQL} SELECT DISTINCT s || '/' || l AS path FROM d WHERE {_PRUNED} UNION SELECT DISTINCT s FROM d WHERE s = 'src1'")
def ignore_pruned(spark, sf_dir):
    """Folders that a walk need not enter: ignored, and no negation leads into them."""
    paths, given, files = _tree(spark, sf_dir)
    dirs = paths.select(F.explode(ignore.folders(F.col("path"))).alias("path")).where("path <> ''").distinct()
    return ignore.prunable(dirs, given.unionByName(ignore.found(files, IGNORE_KINDS)))


@query("ignore_walk", f"WITH {_IGNORE_SQL} SELECT path, ignored FROM d WHERE NOT ({_PRUNED})")
def ignore_walk(spark, sf_dir):
    """What a walk from the root meets."""
    paths, given, files = _tree(spark, sf_dir)
    return ignore.walk(paths, given, files, IGNORE_KINDS).select("path", "ignored")


def seeded(spark, sf_dir):
    secret = F.concat(F.lit('\napi_key = "'), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 32), F.lit('"'))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", secret)).otherwise(F.col("text")).alias("text"))


_SPACE = r" \t\n\x0B\f\r"
#: What a word boundary takes for a letter.
_LETTER = r"\p{L}\p{Nd}\p{Mn}"
_BARE = r"""regexp_replace(trim(v, ' '), '^["'']+|["'']+$', '', 'g')"""


def _stated(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pattern(pattern: str, group: int) -> str:
    """A rule's pattern as the SQL's engine reads it, with the value as the only group: blanks and cases of letters are spelled out, since
    there they go beyond ASCII, and word boundaries, which there see ASCII only, take the character before and a letter right after."""
    given = pattern.replace(S._LEADING, "")
    out, k, folds, in_class = "", 0, given.startswith("(?i)"), False
    given = given.removeprefix("(?i)").replace(r'\b["', '["')  # a quote, a blank or a sign follows there, so the boundary always holds
    bounded, ends = given.startswith(r"\b"), given.endswith(r"\b")
    given = given.replace(r"\b|\b", "|").removeprefix(r"\b").removesuffix(r"\b")
    while k < len(given):
        c = given[k : k + 2] if given[k] == "\\" else given[k]
        in_class = (in_class or c == "[") and c != "]"
        out += (_SPACE if in_class else f"[{_SPACE}]") if c == r"\s" else f"[{c.upper()}{c.lower()}]" if folds and not in_class and len(c) == 1 and c.isalpha() else c
        k += len(c)
    out = out if group else rf"((?:{out})\b[{_LETTER}]?)" if ends else f"({out})"
    return (rf"(?:^|[^{_LETTER}_])" if bounded else "") + out


def _rule_sql(name: str, severity: int, action: str, precise: bool, least: int, bits: float, group: int, pattern: str) -> str:
    random = f" AND len(list_distinct(string_split(v, ''))) >= 6 AND list_aggregate(string_split(v, ''), 'entropy') >= {bits}" if bits else ""
    whole = r" WHERE NOT regexp_matches(v, '[^\x00-\x7F]$')" if pattern.endswith(r"\b") else ""
    return f"""SELECT doc_id, line, '{name}' AS rule, {severity} AS severity, '{action}' AS action, v FROM (SELECT doc_id, line, {_BARE} AS v
        FROM (SELECT doc_id, line, unnest(regexp_extract_all(s, {_stated(_pattern(pattern, group))}, 1)) AS v FROM l){whole}) WHERE length(v) >= {max(least, 1)}{random}"""


_STAND_IN = " OR ".join([f"lower(v) IN ({', '.join(map(_stated, S.PLACEHOLDERS))})", *(f"contains(lower(v), {_stated(x)})" for x in S.PLACEHOLDER_PARTS), *(f"regexp_matches(v, {_stated(x)})" for x in S.PLACEHOLDER_PATTERNS)])
#: Every rule on every line of every document, planted or not; a value counts once a document and rule, on its first line.
_FOUND = rf"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'api_key = "' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 32) || '"' ELSE text END AS text FROM documents),
    t AS (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS ls FROM p), l AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS line FROM t),
    h AS ({" UNION ALL ".join(_rule_sql(*rule) for rule in S.RULES)}),
    s AS (SELECT doc_id, rule, severity, action, substr(sha256(v), 1, 16) AS digest, CAST(min(line) AS INTEGER) AS line, min(v) AS v FROM h WHERE NOT ({_STAND_IN}) GROUP BY ALL)"""


def _findings(docs):
    return S.findings(docs, longest=None)


@query("security_findings", _FOUND + " SELECT doc_id, rule, severity, line, digest FROM s")
def security_findings(spark, sf_dir):
    return _findings(seeded(spark, sf_dir)).select("doc_id", "rule", "severity", "line", "digest")


@query("verdict_per_file", _FOUND + " SELECT doc_id, CASE WHEN bool_or(action = 'block' OR severity >= 4) THEN 'block' ELSE 'redact' END AS verdict, first(rule ORDER BY severity DESC, line, rule DESC) AS worst_rule, count(*) AS n FROM s GROUP BY doc_id")
def verdict_per_file(spark, sf_dir):
    return S.verdicts(_findings(seeded(spark, sf_dir)))


@query("redaction_counts", _FOUND + """, o AS (SELECT doc_id, list({'t': '', 'v': v, 'r': '[REDACTED:' || rule || ']'} ORDER BY length(v) DESC, v, rule) AS vs FROM s GROUP BY doc_id),
    c AS (SELECT doc_id, list_reduce(list_concat([{'t': text, 'v': '', 'r': ''}], vs), lambda a, x: {'t': replace(a.t, x.v, x.r), 'v': '', 'r': ''}).t AS text FROM p JOIN o USING (doc_id))
    SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, sha256(text) AS hash FROM c""")
def redaction_counts(spark, sf_dir):
    docs = seeded(spark, sf_dir)
    return S.redacted(docs, _findings(docs)).select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.sha2("text", 256).alias("hash"))


@query("severity_adjust", "SELECT event_id, CAST(CASE WHEN user_id % 3 = 0 THEN least(s + 1, 4) WHEN user_id % 3 = 1 AND event_type <> 'error' THEN greatest(s - 1, 2) ELSE s END AS INTEGER) AS severity FROM (SELECT *, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 2 END AS s FROM events) t")
def severity_adjust(spark, sf_dir):
    e, u = F.col("event_type"), F.col("user_id") % 3
    s = F.when(e == "error", 4).when(e == "purchase", 3).otherwise(2)
    return read_table(spark, sf_dir, "events").select("event_id", S.adjusted(s, u == 0, u == 1, e == "error").cast("int").alias("severity"))


@query("scan_report", _FOUND + " SELECT count(DISTINCT doc_id) AS files, count(*) AS findings, coalesce(max(severity) >= 4, false) AS failed FROM s")
def scan_report(spark, sf_dir):
    return _findings(seeded(spark, sf_dir)).agg(F.countDistinct("doc_id").alias("files"), F.count("*").alias("findings"), F.coalesce(F.max("severity") >= 4, F.lit(False)).alias("failed"))


#: File names that documents are given in turn, below their source and language.
_NAMES = (".env", ".env.example", "prod.env", "cert.pem", "server.key", "id_rsa.pub", ".ssh/known", "credentials.json", "credentials.py", "secrets.yaml", "my_secrets.md", "tokens.json", "tokens.ts",
          "api_token.txt", "auth_token.go", "passwd.bak", ".netrc", ".aws/config", "gcp-x.json", "v.kdbx", "main.tfvars", "app.py", "README.md")
_PATHS = f"""n AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '/' || {list(_NAMES)}[doc_id % {len(_NAMES)} + 1] AS path FROM documents),
    s AS (SELECT *, string_split(path, '/')[-1] AS name, regexp_matches(path, '[.](py|ts|go|md)$') AS code FROM n),
    v AS (SELECT doc_id, path, CASE WHEN regexp_matches(name, '[.](example|sample|template|dist)$') OR name = '.env.test' THEN NULL WHEN regexp_matches(name, '^[.]env([.]|$)|[.]env$') THEN 'dotenv'
        WHEN regexp_matches(name, '[.](pem|p12|pfx|jks|keystore|asc)$') THEN 'pem' WHEN regexp_matches(name, '[.](key|ppk)$') THEN 'private-key' WHEN regexp_matches(name, '^id_(rsa|ed25519)([.]|$)') OR contains(path, '/.ssh/') THEN 'ssh-private-key'
        WHEN contains(name, 'credential') AND NOT code THEN 'credentials' WHEN contains(name, 'secrets') AND NOT code THEN 'secrets' WHEN (regexp_matches(name, '^tokens?([.](txt|json|ya?ml|toml))?$') OR regexp_matches(name, '[_-]tokens?([.]|$)')) AND NOT code THEN 'tokens'
        WHEN regexp_matches(name, '^passw(or)?d') AND NOT code THEN 'password-file' WHEN name IN ('.netrc', '_netrc', '.pgpass', '.my.cnf') THEN 'shell-credentials' WHEN contains(path, '/.aws/') OR regexp_matches(name, '^gcp-.*[.]json$') THEN 'cloud-credentials'
        WHEN name LIKE '%.kdbx' THEN 'password-manager' WHEN regexp_matches(name, '[.]tf(state|vars)$') THEN 'terraform-state' END AS rule FROM s)"""


def named(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    return read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.concat_ws("/", "source", "lang", "doc_id", name).alias("path"))


@query("filename_findings", f"WITH {_PATHS} SELECT doc_id, path, rule, CAST(CASE WHEN rule = 'terraform-state' THEN 3 WHEN rule IS NOT NULL THEN 4 END AS INTEGER) AS severity FROM v")
def filename_findings(spark, sf_dir):
    """What the names of files condemn: templates pass, code passes where the content decides."""
    return named(spark, sf_dir).withColumn("f", filenames.finding(F.col("path"))).select("doc_id", "path", "f.rule", "f.severity")


@query("verdict_reuse", f"""WITH {_PATHS} SELECT d.doc_id, CASE WHEN d.doc_id % 10 <> 0 AND d.doc_id % 4 <> 1 THEN CASE WHEN rule IS NULL THEN 'clean' ELSE 'block' END END AS verdict,
    d.doc_id % 10 <> 0 AND d.doc_id % 4 <> 1 AS reused FROM v JOIN documents d USING (doc_id)""")
def verdict_reuse(spark, sf_dir):
    """Kept verdicts, of which every tenth file has another size and every fourth was made under another policy."""
    now, then = (filenames.context(filenames.DENIED, {"policy": p}, {"rules": 1}) for p in ("balanced", "strict"))
    files = named(spark, sf_dir).select("doc_id", "path", F.col("n_chars").alias("size"), F.col("doc_id").alias("modified"))
    made = F.when(F.col("doc_id") % 4 == 1, then).otherwise(now)
    verdict = F.when(filenames.finding(F.col("path")).isNull(), "clean").otherwise("block")
    kept = files.select("path", (F.col("size") + (F.col("doc_id") % 10 == 0).cast("int")).alias("size"), "modified", made.alias("context"), verdict.alias("verdict"))
    return filenames.reusable(files, kept, now).select("doc_id", "verdict", "reused")
