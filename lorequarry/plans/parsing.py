"""Parsing queries over texts in several notations, derived from documents, and lookups of names and paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.operators import parsing
from lorequarry.plans.registry import both, query
from lorequarry.session import read_table

#: Endings of made-up paths, and what they stand for, stated here for the check.
_ENDINGS = ("md", "MARKDOWN", "txt", "rst", "py", "pyi", "php", "js", "jsx", "ts", "tsx", "json", "yaml", "yml", "xml", "sql", "toml", "html", "py~", "")
_BY_ENDING = (
    (".md", "markdown"), (".markdown", "markdown"), (".txt", "text"), (".rst", "text"), (".py", "python"), (".pyi", "python"), (".php", "php"), (".js", "javascript"), (".jsx", "javascript"),
    (".ts", "typescript"), (".tsx", "typescript"), (".json", "json"), (".yaml", "yaml"), (".yml", "yaml"), (".xml", "xml"), (".sql", "sql"), (".toml", "toml"),
)

both("path_lookup", "SELECT doc_id FROM {documents} WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = documents.doc_id AND l.quality = 0)".replace("{documents} WHERE", "{documents} AS documents WHERE"))
both("selected_prefixes", "SELECT doc_id FROM {documents} d WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT source FROM {documents} WHERE doc_id < 5) p WHERE p.source = d.source)")
both("fingerprints", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size FROM {documents} GROUP BY source")
both("services", """SELECT p_brand AS service, count(DISTINCT l_suppkey) AS used_by, count(*) AS refs FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY p_brand HAVING count(*) >= 3""")
both("repo_map_lines", "SELECT source, concat(source, ': ', min(lang), ', ', max(lang)) AS line FROM {documents} GROUP BY source")
both("tolerant_timestamps", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'not a date' ELSE CAST(ts AS STRING) END AS DATE) AS day FROM {events}")
both("stale_models", "SELECT vec_id FROM {embeddings} WHERE label <> (SELECT max(label) FROM {embeddings})")
both("coarse_gate", "SELECT label, min(CASE WHEN embedding IS NULL THEN 0 ELSE 1 END) = 1 AS exact FROM {embeddings} GROUP BY label")
both("model_divergence", "SELECT count(DISTINCT label) > 1 AS degraded FROM {embeddings}")
both("slice_by_kind", "SELECT p_type AS kind, count(*) AS items, min(p_name) AS first FROM {part} GROUP BY p_type")
both("hub_ingest_skip", "SELECT a.s_suppkey FROM {supplier} a WHERE NOT EXISTS (SELECT 1 FROM {supplier} b WHERE b.s_suppkey = a.s_suppkey AND b.s_acctbal = a.s_acctbal AND b.s_suppkey % 3 <> 0)")
both("workspace_dictionary", """SELECT n_name, coalesce(c.n, 0) AS consumers, coalesce(s.n, 0) AS providers FROM {nation} LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s ON s_nationkey = n_nationkey""")
both("idle_median", """SELECT round(median(value), 4) AS idle FROM (SELECT value FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 200) t""")
both("consolidation_points", """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events} WHERE event_type <> 'view') t WHERE n % 20 = 0""")
both("touch_batches", """SELECT lane, batch, count(*) AS n, min(user_id) AS first FROM (SELECT user_id, user_id % 8 AS lane, CAST(floor((row_number() OVER (PARTITION BY user_id % 8 ORDER BY user_id) - 1) / 10) AS BIGINT) AS batch FROM (SELECT DISTINCT user_id FROM {events}) d) t GROUP BY lane, batch""")
both("metric_by_class", "SELECT quality, toxic, count(*) AS cases, round(avg(CASE WHEN n_chars > 1500 THEN 1.0E0 ELSE 0.0E0 END), 4) AS rate FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY quality, toxic")
both("session_union", "SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT user_id, ts FROM {events} WHERE event_type = 'view' UNION ALL SELECT user_id, ts FROM {events} WHERE event_type = 'click') t GROUP BY user_id HAVING min(ts) >= (SELECT min(ts) FROM {events})")

both("pruned_directories", "SELECT source, max(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END) = 0 OR source LIKE 'src1_' AS pruned FROM {documents} GROUP BY source")
both("vector_diagnostics", "SELECT count(*) AS vectors, count(CASE WHEN embedding IS NULL THEN 1 END) AS coarse_only, count(DISTINCT label) AS models, count(CASE WHEN embedding IS NULL THEN 1 END) > 0 AS partial FROM {embeddings}")
both("scoped_documents", "SELECT doc_id, source AS project FROM {documents} WHERE source = 'src3' AND n_chars BETWEEN 200 AND 4000")


def notations(spark, sf_dir):
    """Each document's first line in one of five notations, by its id."""
    docs, k = read_table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    name = F.concat(F.lit("part_"), F.col("doc_id").cast("string"))
    said = F.to_json(F.array(F.substring_index("text", "\n", 1)))
    texts = {
        "python": F.concat(F.lit("import os\n\nclass A:\n    def "), name, F.lit("(self):\n        return "), said, F.lit("\n\ndef last():\n    return 1\n")),
        "markdown": F.concat(F.lit("# Title\n\n```\n# not\n```\n## "), name, F.lit("\n"), said, F.lit("\nSet\n===\nend")),
        "json": F.concat(F.lit('{"'), name, F.lit('": '), said, F.lit(', "b": 1}')),
        "toml": F.concat(F.lit("["), name, F.lit("]\na = 1\n")),
        "python_broken": F.concat(F.lit("def broken(:\n\n"), said),
    }
    text, lang = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (notation, column) in enumerate(texts.items()):
        text, lang = F.when(k == i, column).otherwise(text), F.when(k == i, notation.split("_")[0]).otherwise(lang)
    return docs.select("doc_id", lang.alias("lang"), text.alias("text"))


@query("parsed_nodes", """SELECT kind, degraded, count(*) AS n FROM (SELECT unnest(CASE doc_id % 5 WHEN 0 THEN ['import', 'class', 'method', 'function'] WHEN 1 THEN ['section', 'section', 'section'] WHEN 2 THEN ['key', 'key'] WHEN 3 THEN ['key'] ELSE ['paragraph', 'paragraph'] END) AS kind, doc_id % 5 = 4 AS degraded FROM documents) t GROUP BY ALL""")
def parsed_nodes(spark, sf_dir):
    return parsing.parse(notations(spark, sf_dir)).groupBy("kind", "degraded").agg(F.count("*").alias("n"))


@query("language_by_extension", """SELECT doc_id, e.language FROM (SELECT doc_id, lower('.' || [%s][doc_id %% 20 + 1]) AS ext FROM documents) d
    LEFT JOIN (VALUES %s) AS e(ext, language) USING (ext)""" % (
    ", ".join(f"'{x}'" for x in _ENDINGS), ", ".join(f"('{x}', '{name}')" for x, name in _BY_ENDING)))
def language_by_extension(spark, sf_dir):
    """Paths made of a document's source and an ending by its id; the closed list decides."""
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int"))
    return read_table(spark, sf_dir, "documents").select("doc_id", parsing.language(F.concat("source", F.lit("/a.b/x."), ending)).alias("language"))


#: Shell lines (``{}`` is a word of the data) and their classes, stated here for the check.
_LINES = (
    ("cd x && FOO=1 sudo cat {}.txt | wc", "read"), ("xargs -0 grep -n {}", "search"), ("cat {} | git ls-files", "search"), ("make {}", "other"),
    ("/usr/bin/head -n 3 {}", "read"), ("sed -n 1,20p {}", "read"), ("sed s/a/b/ {}", "other"), ("C:\\tools\\RG.exe {}", "search"), ("git commit -m {}", "other"),
    ("(time -p find . -name {})", "search"), ("env A=1 B=2 nice -n5 less {}", "read"), ("echo {} ; Select-String x", "search"), ("grepx {} || catx", "other"), ("", "other"),
)


@query("command_classes", "SELECT class, count(*) AS n FROM (SELECT [%s][event_id %% %d + 1] AS class FROM events) t GROUP BY class" % (", ".join(f"'{c}'" for _, c in _LINES), len(_LINES)))
def command_classes(spark, sf_dir):
    """Shell lines that each name an event's type and user, by the class of their command."""
    line = F.element_at(F.array(*[F.lit(x) for x, _ in _LINES]), (F.col("event_id") % len(_LINES) + 1).cast("int"))
    line = F.replace(line, F.lit("{}"), F.concat_ws("-", "event_type", F.col("user_id").cast("string")))
    return read_table(spark, sf_dir, "events").select(parsing.command_class(line).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("common_path_prefix", """WITH s AS (SELECT source, unnest(string_split(source || '/' || lang || '/x', '/')) AS part, generate_subscripts(string_split(source || '/' || lang || '/x', '/'), 1) AS k FROM documents)
    SELECT source, CAST(coalesce(min(CASE WHEN n > 1 THEN k END) - 1, max(k)) AS INTEGER) AS shared FROM (SELECT source, k, count(DISTINCT lower(part)) AS n FROM s GROUP BY source, k) t GROUP BY source""")
def common_path_prefix(spark, sf_dir):
    parts = read_table(spark, sf_dir, "documents").select("source", F.posexplode(F.split(F.concat_ws("/", "source", "lang", F.lit("x")), "/")).alias("p", "part"))
    per = parts.groupBy("source", (F.col("p") + 1).alias("k")).agg(F.countDistinct(F.lower("part")).alias("n"))
    return per.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("n") > 1, F.col("k"))) - 1, F.max("k")).alias("shared"))


@query("folded_search", """SELECT doc_id, CASE WHEN starts_with(f, 'e') THEN 1 ELSE 2 END AS tier FROM (SELECT doc_id, strip_accents(lower(text)) AS f FROM documents) t WHERE contains(f, 'e')""")
def folded_search(spark, sf_dir):
    """Accents and case fold away; a hit at the start ranks before one inside."""
    folded = F.translate(F.lower("text"), "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    return read_table(spark, sf_dir, "documents").select("doc_id", folded.alias("f")).where("contains(f, 'e')").select("doc_id", F.when(F.startswith("f", F.lit("e")), 1).otherwise(2).alias("tier"))


@query("phrase_hits", """SELECT item_id, count(*) AS docs FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark) q JOIN documents d ON contains(' ' || array_to_string(regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}]+'), ' ') || ' ', ' ' || w[2] || ' ' || w[3] || ' ' || w[4] || ' ') GROUP BY item_id""")
def phrase_hits(spark, sf_dir):
    """Documents that hold three words of a query next to each other: equality of word triples, so an ordinary join."""
    w = T.words(F.col("text"))
    asked = read_table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(w, 2, 3), " ").alias("phrase"))
    triples = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 3), " ")))
    held = read_table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.explode(triples).alias("phrase"))
    return held.join(asked, "phrase").groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))


@query("masked_echo")
def masked_echo(spark, sf_dir):
    """Words of queries that look random come back as a preview only."""
    from lorequarry.functions.stats import looks_random

    word = F.explode(F.split(F.concat("text", F.lit(" "), F.substring(F.sha2("text", 256), 1, 20)), " ")).alias("w")
    words = read_table(spark, sf_dir, "benchmark").select("item_id", word)
    return words.select("item_id", F.when(looks_random(F.col("w")), F.concat(F.substring("w", 1, 4), F.lit("…"), F.substring("w", -4, 4))).otherwise(F.col("w")).alias("shown"))


@query("newest_events", "SELECT event_type, event_id, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS) t WHERE rn <= 500")
def newest_events(spark, sf_dir):
    """The activity tail: the last day, the newest five hundred of each kind."""
    events = read_table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = events.join(F.broadcast(last)).where("ts >= last - INTERVAL 24 HOURS")  # one row
    return recent.withColumn("rn", F.row_number().over(w)).where("rn <= 500").select("event_type", "event_id", "rn")


@query("version_log", """SELECT o_custkey, count(*) AS commits, max(o_orderdate) AS last FROM orders GROUP BY o_custkey""")
def version_log(spark, sf_dir):
    """A captured log, one line a commit (hash, date, subject, files), parsed again."""
    line = F.concat_ws("\t", F.sha2(F.col("o_orderkey").cast("string"), 256), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("fix: order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("M src/"), F.col("o_custkey").cast("string")))
    parts = F.split("line", "\t")
    rows = read_table(spark, sf_dir, "orders").select(line.alias("line")).select(F.to_timestamp_ntz(parts[1], F.lit("yyyy-MM-dd HH:mm:ss")).alias("at"), F.regexp_extract(parts[3], r"^[AMDR]\d* src/(\d+)$", 1).cast("long").alias("o_custkey"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("commits"), F.max("at").alias("last"))


@query("import_extraction", r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'os.path' WHEN doc_id % 3 = 1 THEN './' || source ELSE 'App\' || lang END AS module FROM documents""")
def import_extraction(spark, sf_dir):
    """Modules that a line imports, in three languages."""
    k = F.col("doc_id") % 3
    line = F.when(k == 0, "from os.path import join").when(k == 1, F.concat(F.lit("const a = require('./"), "source", F.lit("')"))).otherwise(F.concat(F.lit("use App\\"), "lang", F.lit(";")))
    found = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in (r"^\s*from\s+([\w.]+)\s+import", r"""(?:from\s+|require\()\s*['"]([^'"]+)['"]""", r"^\s*use\s+([\w\\]+)")])
    return read_table(spark, sf_dir, "documents").select("doc_id", line.alias("line")).select("doc_id", found.alias("module"))


@query("simulated_arms", "SELECT user_id, arm, CAST('0x' || substr(sha256(user_id || ':' || arm), 1, 6) AS BIGINT) % 1000 AS tokens FROM (SELECT DISTINCT user_id, event_type AS arm FROM events) t")
def simulated_arms(spark, sf_dir):
    """Results of arms that follow from a hash of task and arm, the same in every run."""
    arms = read_table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("arm")).distinct()
    return arms.select("user_id", "arm", (F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "arm"), 256), 1, 6), 16, 10).cast("long") % 1000).alias("tokens"))
