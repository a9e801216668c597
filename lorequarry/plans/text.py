"""Text, identity and scalar-function queries over documents, passages, pages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorequarry.functions import ids as I
from lorequarry.functions import stats as ST
from lorequarry.functions import text as T
from lorequarry.functions import vector as V
from lorequarry.operators import chunking, embedding, units
from lorequarry.plans.registry import query
from lorequarry.session import read_table

_PATH = "source || '/' || doc_id || '.md'"


def path() -> F.Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


@query("token_count", r"""SELECT doc_id, CAST(list_sum(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), lambda t: CASE WHEN length(t) <= 4 THEN 1 ELSE ceil(length(t) / 4.0) END)) AS BIGINT) AS tokens FROM documents""")
def token_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("content_id", f"""SELECT doc_id, substr(sha256({_PATH}), 1, 32) AS document_id, substr(sha256({_PATH} || chr(0) || text || chr(0) || '1'), 1, 32) AS chunk_id FROM documents""".replace("|| chr(0) ||", "|| chr(0) ||"))
def content_id(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", I.digest(path()).alias("document_id"), I.digest(path(), F.col("text"), F.lit("1")).alias("chunk_id"))


@query("content_hash", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g')) AS hash FROM documents""")
def content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", I.content_hash(F.col("text")).alias("hash"))


@query("shard_distribution", f"""SELECT lower(printf('%02X', CAST('0x' || substr(sha256({_PATH}), 1, 8) AS BIGINT) % 16)) AS shard, count(*) AS n FROM documents GROUP BY 1""")
def shard_distribution(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(I.shard_of(I.digest(path()), 16).alias("shard")).agg(F.count("*").alias("n"))


@query("intersect_hashes", "SELECT sha256(text) AS hash FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1")
def intersect_hashes(spark, sf_dir):
    hashed = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash"))
    return hashed.where("doc_id % 2 = 0").select("hash").intersect(hashed.where("doc_id % 2 = 1").select("hash"))


@query("snippet")
def snippet(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.snippet(F.col("text"), 160).alias("snippet"))


@query("snippet_line", "SELECT doc_id, substr(trim(coalesce(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1], '')), 1, 120) AS line FROM documents")
def snippet_line(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.line_snippet(F.col("text"), 120).alias("line"))


@query("detectors", r"""SELECT doc_id, regexp_matches(text, '(?i)\?|^\s*(como|o que|oque|por que|porque|quando|onde|qual|quais|quem)\b') AS question, regexp_matches(text, '[a-z][A-Z]|::|\(\)|_[a-z]|\.[a-z]+\(') AS identifier FROM documents""")
def detectors(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.is_question(F.col("text")).alias("question"), T.is_identifier(F.col("text")).alias("identifier"))


@query("intent_detect", "SELECT conv_id, turn, CASE " + " ".join(rf"WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_]){T.intent_core(p)}([^\p{{L}}\p{{N}}_]|$)') THEN '{n}'" for n, patterns in T.INTENTS for p in patterns) + " ELSE 'general' END AS intent FROM conversations")
def intent_detect(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


@query("tier_of_path", rf"""SELECT page_id, CASE WHEN regexp_matches(p, '(^|/)(task|tasks|backlog|stories|planning)/') THEN 'work' WHEN regexp_matches(p, '(^|/)(tests|test|spec|specs|__tests__)/') THEN 'test' ELSE 'knowledge' END AS tier
    FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'task/' WHEN page_id % 5 = 1 THEN 'src/tests/' ELSE 'src/' END || page_id AS p FROM pages) t""")
def tier_of_path(spark, sf_dir):
    p = F.concat(F.when(F.col("page_id") % 5 == 0, "task/").when(F.col("page_id") % 5 == 1, "src/tests/").otherwise("src/"), F.col("page_id").cast("string"))
    return read_table(spark, sf_dir, "pages").select("page_id", T.tier(p).alias("tier"))


@query("split_identifiers", r"""SELECT doc_id, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_.-]+', ' ', 'g')), ' +'), lambda p: length(p) > 1) AS parts
    FROM (SELECT doc_id, lang || 'Doc_' || source || '.Part' || CAST(doc_id AS VARCHAR) AS w FROM documents) t""")
def split_identifiers(spark, sf_dir):
    w = F.concat("lang", F.lit("Doc_"), "source", F.lit(".Part"), F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select("doc_id", T.split_identifier(w).alias("parts"))


@query("query_terms")
def query_terms(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select("item_id", T.query_terms(F.col("text")).alias("terms"))


@query("glossary_terms", r"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS term FROM documents) t WHERE regexp_full_match(term, '[A-Z]{2,6}') GROUP BY term HAVING count(*) >= 2""")
def glossary_terms(spark, sf_dir):
    found = docs(spark, sf_dir).select(F.explode(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: w.rlike("^[A-Z]{2,6}$"))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n")).where("n >= 2")


@query("technologies", """SELECT lang, list_slice(list_sort(list(DISTINCT source)), 1, 5) AS evidence FROM documents GROUP BY lang""")
def technologies(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.slice(F.array_sort(F.collect_set("source")), 1, 5).alias("evidence"))


@query("route_normal", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace('/' || regexp_replace(url, '^[a-z]+://[^/?#]*/?', ''), '\d+', ':id', 'g'), ':[A-Za-z_][A-Za-z0-9_]*', '{}', 'g'), '/+', '/', 'g') AS route FROM pages""")
def route_normal(spark, sf_dir):
    p = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://[^/?#]*/?", "")), r"\d+", ":id")
    return read_table(spark, sf_dir, "pages").select("page_id", T.route(p).alias("route"))


@query("strip_host", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages")
def strip_host(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*(/[^?#]*)?", 1).alias("path"))


@query("event_name_normal", "SELECT event_id, lower(regexp_replace(trim(' ' || event_type || ' . done '), '[ .]+', '.', 'g')) AS name FROM events")
def event_name_normal(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.lower(F.regexp_replace(F.trim(F.concat(F.lit(" "), "event_type", F.lit(" . done "))), "[ .]+", ".")).alias("name"))


@query("call_extraction", r"""SELECT page_id, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS name FROM pages) t GROUP BY page_id""")
def call_extraction(spark, sf_dir):
    found = read_table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1))).alias("name"))
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query("tool_category", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'read' WHEN event_type = 'click' THEN 'search' ELSE 'other' END AS category FROM events")
def tool_category(spark, sf_dir):
    e = F.col("event_type")
    return read_table(spark, sf_dir, "events").select("event_id", F.when(e == "view", "read").when(e == "click", "search").otherwise("other").alias("category"))


@query("clean_subjects", r"SELECT doc_id, trim(regexp_replace(regexp_replace(trim('fix(' || lang || '): ' || split_part(text, chr(10), 1) || ' (DOC-' || doc_id || ')'), '^[a-z]+(\([^)]*\))?!?:\s*', ''), '\s*\([A-Z]+-[0-9]+\)\s*$', '')) AS subject FROM documents")
def clean_subjects(spark, sf_dir):
    s = F.concat(F.lit("fix("), "lang", F.lit("): "), F.substring_index("text", "\n", 1), F.lit(" (DOC-"), F.col("doc_id").cast("string"), F.lit(")"))
    return docs(spark, sf_dir).select("doc_id", T.clean_subject(s).alias("subject"))


@query("cited_paths", r"""SELECT page_id, list_distinct(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) IS NOT NULL AS cited, len(list_distinct(regexp_extract_all(html, 'href="(/[^"]+)"', 1))) AS n FROM pages""")
def cited_paths(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), F.lit(1)))
    return read_table(spark, sf_dir, "pages").select("page_id", found.isNotNull().alias("cited"), F.size(found).cast("long").alias("n"))


@query("artifact_names", f"""SELECT doc_id, replace(p, '/', '__') || CASE WHEN contains(p, '__') THEN '-' || substr(sha256(p), 1, 6) ELSE '' END AS name FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a__b/' ELSE '' END || {_PATH} AS p FROM documents) t""")
def artifact_names(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.artifact_name(F.concat(F.when(F.col("doc_id") % 3 == 0, "a__b/").otherwise(""), path())).alias("name"))


@query("preview_masked", "SELECT doc_id, CASE WHEN length(text) < 16 THEN '(hidden)' ELSE substr(sha256(text), 1, 4) || '…' || right(sha256(text), 4) END AS preview FROM documents")
def preview_masked(spark, sf_dir):
    h = F.sha2("text", 256)
    return docs(spark, sf_dir).select("doc_id", F.when(F.length("text") < 16, "(hidden)").otherwise(F.concat(F.substring(h, 1, 4), F.lit("…"), F.substring(h, -4, 4))).alias("preview"))


@query("terms_without_stop_words", "SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{3,}'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")) AS terms FROM benchmark")
def terms_without_stop_words(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select("item_id", T.terms(F.col("text")).alias("terms"))


@query("slugs")
def slugs(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select("item_id", T.slug(F.col("text")).alias("slug"))


@query("wire_rows", f"SELECT substr(sha256({_PATH}), 1, 12) AS id, '{{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}}' AS body FROM documents")
def wire_rows(spark, sf_dir):
    """Compact JSON without null keys, under a twelve-digit id."""
    return docs(spark, sf_dir).select(F.substring(I.digest(path()), 1, 12).alias("id"), F.to_json(F.struct("lang", F.lit(None).cast("string").alias("gone"), F.col("n_chars").alias("n"))).alias("body"))


@query("path_checks", r"SELECT page_id, NOT regexp_matches(p, '^([A-Za-z]:|[/\\])|(^|[/\\])\.\.([/\\]|$)') AND p <> '' AS valid FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN 'C:' ELSE '' END || 'a/' || page_id AS p FROM pages) t")
def path_checks(spark, sf_dir):
    p = F.concat(F.when(F.col("page_id") % 4 == 0, "/").when(F.col("page_id") % 4 == 1, "../").when(F.col("page_id") % 4 == 2, "C:").otherwise(""), F.lit("a/"), F.col("page_id").cast("string"))
    return read_table(spark, sf_dir, "pages").select("page_id", T.valid_path(p).alias("valid"))


@query("module_counts", "SELECT source || '/' || lang AS module, count(*) AS n FROM documents GROUP BY 1")
def module_counts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(T.module_of(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))).alias("module")).agg(F.count("*").alias("n"))


@query("context_string", "SELECT doc_id, concat_ws(' › ', source, CASE WHEN doc_id % 2 = 0 THEN lang END, CAST(doc_id AS VARCHAR)) AS context FROM documents")
def context_string(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.concat_ws(" › ", "source", F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("doc_id").cast("string")).alias("context"))


@query("entropy_score", """SELECT item_id, round(-sum(p * log2(p)), 4) AS entropy FROM (SELECT item_id, c, count(*) / sum(count(*)) OVER (PARTITION BY item_id) AS p FROM (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark) a GROUP BY item_id, c) b GROUP BY item_id""")
def entropy_score(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.round(ST.entropy(F.col("text")), 4).alias("entropy"))


@query("normalized_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def normalized_vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("quantize_roundtrip", """WITH s AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM s),
    q AS (SELECT vec_id, u, list_min(u) AS low, (list_max(u) - list_min(u)) / 255 AS scale FROM u)
    SELECT vec_id, round(list_max(list_transform(u, lambda x: abs(x - (round_even((x - low) / scale, 0) * scale + low)))) / scale, 3) <= 0.501 AS within_half_step FROM q""")
def quantize_roundtrip(spark, sf_dir):
    v = F.col("embedding")
    q = read_table(spark, sf_dir, "embeddings").select("vec_id", V.normalized(F.slice(v, 1, 32)).alias("u"), V.quantized(v, 32).alias("q"))
    off = F.array_max(F.zip_with("u", V.dequantized(F.col("q")), lambda a, b: F.abs(a - b)))
    return q.select("vec_id", (F.round(off / F.col("q.scale"), 3) <= 0.501).alias("within_half_step"))


@query("chunks_by_line", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    t AS (SELECT doc_id, n, CAST(floor((sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1) / 2000) AS BIGINT) AS ordinal, line FROM l)
    SELECT doc_id, ordinal, min(n) AS start_line, max(n) AS end_line, sha256(string_agg(line, chr(10) ORDER BY n)) AS hash FROM t GROUP BY doc_id, ordinal""")
def chunks_by_line(spark, sf_dir):
    return chunking.line_chunks(docs(spark, sf_dir), 2000).select("doc_id", "ordinal", "start_line", "end_line", F.sha2("content", 256).alias("hash"))


@query("parsed_pages")
def parsed_pages(spark, sf_dir):
    """Headings, title and paragraphs of pages, as chunks under a token limit."""
    return chunking.page_chunks(read_table(spark, sf_dir, "pages"), 512, 24)


def sources(spark, sf_dir, stem="DocBody"):
    """Each whole document as a Python source: one class, whose methods return its lines."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.regexp_replace(s, r'[\\"\x00-\x1f\x85\u2028\u2029]', " "))
    body = F.transform(lines, lambda s, i: F.concat(F.lit("    def line_"), (i + 1).cast("string"), F.lit('(self):\n        return "'), s, F.lit('"\n')))
    text = F.concat(F.lit("import os\n\n\nclass "), F.lit(stem), F.col("doc_id").cast("string"), F.lit(":\n"), F.array_join(body, "\n"))
    name = F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return docs(spark, sf_dir).select("doc_id", name.alias("path"), F.lit("python").alias("lang"), text.alias("text"))


_TOKENS = r"list_sum(list_transform(regexp_extract_all(%s, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), lambda t: CASE WHEN length(t) <= 4 THEN 1 ELSE ceil(length(t) / 4.0) END))"
#: The same sources line by line: their chunks follow from the lines, with two parts where a line passes the limit.
_UNITS = rf"""p AS (SELECT doc_id, 'src/doc_' || doc_id || '.py' AS path, '{{stem}}' || doc_id AS cls, list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '[\\"\x00-\x1f\x{{{{85}}}}\x{{{{2028}}}}\x{{{{2029}}}}]', ' ', 'g')) AS lines FROM documents),
    l AS (SELECT doc_id, path, cls, n, '    def line_' || n || '(self):' AS head, '        return "' || lines[n] || '"' AS said FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS n FROM p) t),
    w AS (SELECT *, {_TOKENS % "head || chr(10) || said"} > 512 AS parted FROM l),
    c AS (SELECT doc_id, path, 0 AS place, 0 AS part, 'file' AS kind, NULL AS symbol, 1 AS start_line, 1 AS end_line, 'import os' AS content FROM p
        UNION ALL SELECT doc_id, path, 0, 1, 'class', cls, 4, 4, 'class ' || cls || ':' || chr(10) || '# métodos: ' || list_aggregate(list_transform(range(1, len(lines) + 1), lambda i: 'line_' || i), 'string_agg', ', ') FROM p
        UNION ALL SELECT doc_id, path, n, 0, 'method', cls || '.line_' || n || CASE WHEN parted THEN '#part-1' ELSE '' END, 2 + 3 * n, 2 + 3 * n + CASE WHEN parted THEN 0 ELSE 1 END, CASE WHEN parted THEN head ELSE head || chr(10) || said END FROM w
        UNION ALL SELECT doc_id, path, n, 1, 'method', cls || '.line_' || n || '#part-2', 3 + 3 * n, 3 + 3 * n, said FROM w WHERE parted),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content ORDER BY place, part) - 1 AS copy FROM c),
    i AS (SELECT *, substr(sha256(path || chr(0) || content || CASE WHEN copy > 0 THEN '::copy-' || copy || '::' ELSE '' END || chr(0) || '1'), 1, 32) AS chunk_id, trim(string_split(content, chr(10))[1]) AS said FROM u),
    units AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, part) - 1 AS INTEGER) AS ordinal, chunk_id, CASE WHEN kind = 'method' THEN max(CASE WHEN kind = 'class' THEN chunk_id END) OVER (PARTITION BY doc_id) END AS parent_id, kind, symbol,
        CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, content, path || CASE WHEN symbol IS NULL THEN '' ELSE ' › ' || kind || ' ' || symbol || ' › doc ' || doc_id || ' ' || lower(regexp_replace(regexp_replace(symbol, '^([A-Z][a-z]+)([A-Z])', '\1 \2'), '[._-]+', ' ', 'g'))
        || ' › ' || CASE WHEN length(said) > 160 THEN substr(said, 1, 159) || '…' ELSE said END END AS context FROM i)"""


def _units(stem):
    return _UNITS.replace("{stem}", stem).replace("{{", "{").replace("}}", "}")


@query("code_units", f"""WITH {_units("DocBody")} SELECT doc_id, ordinal, chunk_id, parent_id, kind, symbol, start_line, end_line, sha256(content) AS hash, context FROM units""")
def code_units(spark, sf_dir):
    """Class headers without bodies, methods and their parts, with ids, parents and contexts."""
    made = units.units(sources(spark, sf_dir), 512, 0)
    return made.select("doc_id", "ordinal", "chunk_id", "parent_id", "kind", "symbol", "start_line", "end_line", F.sha2("content", 256).alias("hash"), "context")


@query("rechunked_units", f"""WITH {_units("DocBody")}, old AS (SELECT * FROM units), new AS (SELECT * FROM (WITH {_units("DocPage")} SELECT * FROM units) t)
    SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN o.chunk_id IS NULL THEN 'added' WHEN n.chunk_id IS NULL THEN 'removed' WHEN o.parent_id IS NOT DISTINCT FROM n.parent_id THEN 'kept' ELSE 'moved' END AS state,
        n.chunk_id IS NOT NULL AND o.context IS DISTINCT FROM n.context AS embed FROM old o FULL JOIN new n ON n.chunk_id = o.chunk_id""")
def rechunked_units(spark, sf_dir):
    """What a renaming of all classes does to chunks and vectors: methods keep their ids, not their contexts."""
    old, new = (units.units(sources(spark, sf_dir, stem), 512, 0) for stem in ("DocBody", "DocPage"))
    return units.rechunked(old, new)


@query("hashed_vectors")
def hashed_vectors(spark, sf_dir):
    """Deterministic hashing vectors; equal texts are embedded once and joined back by hash."""
    return embedding.embed(docs(spark, sf_dir), 64).select("doc_id", "hash", F.round(V.norm(F.col("vector")), 4).alias("norm"))


@query("embedding_cache", "SELECT count(*) AS rows, count(DISTINCT sha256(text)) AS embedded FROM documents")
def embedding_cache(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.count("*").alias("rows"), F.countDistinct(F.sha2("text", 256)).alias("embedded"))
