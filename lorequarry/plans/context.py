"""Context assembly queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.operators import compress as K
from lorequarry.operators import context as C
from lorequarry.operators import dictionary as DI
from lorequarry.operators import render as R
from lorequarry.operators import search as S
from lorequarry.plans.registry import both, query
from lorequarry.plans.search import BM25_SQL, keyword
from lorequarry.session import cut, read_table

both("intent_weights", "SELECT doc_id, round(n_chars * CASE WHEN doc_id % 3 = 0 THEN 1.25E0 WHEN doc_id % 3 = 1 THEN 1.1E0 ELSE 0.9E0 END, 3) AS weighed FROM {documents}")
both("best_per_document", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM {documents}) t WHERE rn = 1")
both("fragment_cap", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM {conversations}) t WHERE used <= 2000")


@query("literal_dedup", f"""WITH {BM25_SQL}, h AS (SELECT kr.*, sha256(text) AS hash FROM kr JOIN d USING (doc_id) WHERE rank <= 20)
    SELECT query_id, doc_id, row_number() OVER w = 1 AS kept, CASE WHEN row_number() OVER w > 1 THEN first_value(doc_id) OVER w END AS repeats FROM h WINDOW w AS (PARTITION BY query_id, hash ORDER BY rank)""")
def literal_dedup(spark, sf_dir):
    texts = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return C.literal_dedup(keyword(spark, sf_dir, 20).join(texts, "doc_id")).select("query_id", "doc_id", "kept", "repeats")


@query("context_pack")
def context_pack(spark, sf_dir):
    """Near-duplicates, maximal marginal relevance and a budget over the vector hits of every fiftieth vector."""
    vectors = read_table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", T.token_count(F.col("text")).alias("tokens"))
    hits = S.vector_top(vectors, asked, 50).withColumnRenamed("vec_id", "doc_id").join(docs, "doc_id")
    hits = hits.join(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector")), "doc_id")
    return C.assemble(hits, asked.select("query_id", F.col("embedding").cast("array<double>").alias("query")), 3000)


@query("noise_pruning", r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '(?i)^\s*(licensed under|copyright|import |from )') AND trim(l) <> '')) AS lines FROM documents""")
def noise_pruning(spark, sf_dir):
    kept = F.filter(F.split("text", "\n"), lambda line: ~line.rlike(r"(?i)^\s*(licensed under|copyright|import |from )") & (F.trim(line) != ""))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(kept).cast("long").alias("lines"))


@query("line_truncation", """SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, n, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS used FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) a) b WHERE used <= 1500 GROUP BY doc_id""")
def line_truncation(spark, sf_dir):
    lines = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    used = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("n"))
    return lines.withColumn("used", used).where("used <= 1500").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("sentence_select", r"""WITH s AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '[.!?]\s+'), lambda x: trim(x) <> '')) AS s, generate_subscripts(list_filter(string_split_regex(text, '[.!?]\s+'), lambda x: trim(x) <> ''), 1) AS n FROM conversations),
    r AS (SELECT conv_id, turn, n, s, sum(length(s)) OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN n = 1 THEN 0.5 ELSE 0 END + CASE WHEN contains(s, 'the') THEN 1 ELSE 0 END DESC, n ROWS UNBOUNDED PRECEDING) AS used FROM s)
    SELECT conv_id, turn, count(*) AS kept, CAST(min(n) AS INTEGER) AS first FROM r WHERE used <= 300 GROUP BY conv_id, turn""")
def sentence_select(spark, sf_dir):
    parts = F.filter(F.split("text", r"[.!?]\s+"), lambda x: F.trim(x) != "")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("k", "s")).withColumn("n", F.col("k") + 1)
    score = F.when(F.col("n") == 1, 0.5).otherwise(0.0) + F.when(F.contains("s", F.lit("the")), 1.0).otherwise(0.0)
    used = F.sum(F.length("s")).over(Window.partitionBy("conv_id", "turn").orderBy(F.desc(score), "n").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where("used <= 300").groupBy("conv_id", "turn").agg(F.count("*").alias("kept"), F.min("n").alias("first"))


@query("context_cache_key", """SELECT item_id, sha256('{"query":' || CAST(to_json(text) AS VARCHAR) || ',"budget":3000,"mode":"hybrid"}') AS key FROM benchmark""")
def context_cache_key(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.to_json(F.struct(F.col("text").alias("query"), F.lit(3000).alias("budget"), F.lit("hybrid").alias("mode"))), 256).alias("key"))


@query("rendered_context", """SELECT conv_id, string_agg('## [' || turn || '] ' || role || chr(10) || text, chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""")
def rendered_context(spark, sf_dir):
    """Markdown of a conversation's turns; conversations in this table are at most a few turns long."""
    part = F.format_string("## [%d] %s\n%s", "turn", "role", "text")
    return read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "\n").alias("markdown"))


_TOKENS = r"CAST(coalesce(list_sum(list_transform(regexp_extract_all(coalesce({}, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda t: CASE WHEN length(t) <= 4 THEN 1 ELSE CAST(ceil(length(t) / 4.0) AS BIGINT) END)), 0) AS BIGINT)"


@query("hard_cap", f"""WITH {BM25_SQL}, h AS (SELECT query_id, doc_id, rank, {_TOKENS.format("text")} AS tokens, {_TOKENS.format("'## [' || rank || '] ' || source || '/' || doc_id || '.md'")} AS header FROM kr JOIN d USING (doc_id) WHERE rank <= 20),
    u AS (SELECT *, sum(tokens + header) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) + 20 AS used FROM h)
    SELECT query_id, doc_id, CAST(rank AS INTEGER) AS place, CAST(CASE WHEN used > 1500 THEN 1480 - header ELSE tokens END AS BIGINT) AS tokens, CAST(least(used, 1500) AS BIGINT) AS used, used > 1500 AS shortened
    FROM u WHERE used <= 1500 OR (rank = 1 AND header + 20 < 1500)""")
def hard_cap(spark, sf_dir):
    """Keyword hits in order of rank, with the headers and the footer that their rendering has, under 1500 tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    hits = keyword(spark, sf_dir, 20).join(docs, "doc_id")
    header = T.token_count(F.format_string("## [%d] %s/%d.md", "rank", "source", "doc_id"))
    rows = hits.select("query_id", "doc_id", F.col("rank").alias("place"), T.token_count(F.col("text")).alias("tokens"), header.alias("header"))
    return C.hard_cap(rows, 1500, 20).drop("header").select("query_id", "doc_id", "place", F.col("tokens").cast("long").alias("tokens"), F.col("used").cast("long").alias("used"), "shortened")


def _tok(x: str) -> str:
    return rf"coalesce(list_sum(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda t: CASE WHEN length(t) <= 4 THEN 1 ELSE CAST(ceil(length(t) / 4.0) AS BIGINT) END)), 0)"


#: Prose with a target of 120 tokens and the query "the of and", over lines and sentences in rows.
_COMPRESS_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_tok("coalesce(text, '')")} AS n FROM documents),
    l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS i FROM t WHERE n > 120),
    k AS (SELECT * FROM l WHERE NOT regexp_matches(x, '(?i)^\s*(?:#|//|\*|/\*)\s*(?:copyright|licensed under|SPDX-License|all rights reserved)') AND NOT regexp_matches(x, '(?i)^\s*(?:#|//|<!--)\s*(?:auto-?generated|do not edit|@generated)')),
    b AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM k),
    p AS (SELECT t.doc_id, t.n, regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT (trim(x) = '' AND coalesce(trim(prev) = '', false))), ''), '^\n+|\n+$', '', 'g') AS p FROM t LEFT JOIN b USING (doc_id) WHERE t.n > 120 GROUP BY t.doc_id, t.n),
    q AS (SELECT *, {_tok("p")} AS np, starts_with(ltrim(split_part(p, chr(10), 1)), '#') AS headed, split_part(p, chr(10), 1) AS head FROM p),
    s AS (SELECT doc_id, headed, head, list_filter(list_transform(string_split(regexp_replace(CASE WHEN headed THEN substr(p, length(head) + 2) ELSE p END, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '') AS s FROM q WHERE np > 120),
    u AS (SELECT doc_id, headed, head, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM s WHERE len(s) > 1),
    r AS (SELECT *, {_tok("s")} AS cost, len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+')), ['the', 'of', 'and'])) / 3 + CASE WHEN i = 1 THEN 0.5 ELSE 0 END AS near FROM u),
    c AS (SELECT *, CASE WHEN headed THEN {_tok("head")} ELSE 0 END + sum(cost) OVER (PARTITION BY doc_id ORDER BY near DESC, i ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY doc_id ORDER BY near DESC, i) AS place FROM r),
    j AS (SELECT doc_id, regexp_replace(CASE WHEN headed THEN head || chr(10) ELSE '' END || string_agg(s, ' ' ORDER BY i), '^\s+|\s+$', '', 'g') AS d FROM c WHERE used <= 120 OR place = 1 GROUP BY doc_id, headed, head),
    d AS (SELECT q.doc_id, q.n, q.np, q.p, coalesce(j.d, q.p) AS d FROM q LEFT JOIN j USING (doc_id)),
    e AS (SELECT *, {_tok("d")} AS nd FROM d),
    m AS (SELECT doc_id, unnest(string_split(regexp_replace(d, '\n$', ''), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(d, '\n$', ''), chr(10)), 1) AS i FROM e WHERE np > 120 AND nd > 120),
    v AS (SELECT *, {_tok("'…(truncado)'")} + sum({_tok("x")}) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS used FROM m),
    w AS (SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (used <= 120), substr(min(x) FILTER (i = 1), 1, 360)) || chr(10) || '…(truncado)' AS d FROM v GROUP BY doc_id),
    o AS (SELECT t.doc_id, CASE WHEN t.n <= 120 THEN 'none' WHEN e.np <= 120 THEN 'prune' WHEN e.nd <= 120 THEN 'sentences' ELSE 'truncate' END AS strategy,
                 CASE WHEN t.n <= 120 THEN t.text WHEN e.np <= 120 THEN e.p WHEN e.nd <= 120 THEN e.d ELSE w.d END AS text, t.n FROM t LEFT JOIN e USING (doc_id) LEFT JOIN w USING (doc_id))
    SELECT doc_id, strategy, sha256(text) AS hash, CAST(n - {_tok("text")} AS BIGINT) AS saved_tokens FROM o"""


@query("compressed_fragments", _COMPRESS_SQL)
def compressed_fragments(spark, sf_dir):
    """Documents as prose through the whole cascade, towards 120 tokens."""
    rows = K.compress(read_table(spark, sf_dir, "documents").select("doc_id", "text"), target=120, query=F.lit("the of and"))
    return rows.select("doc_id", "strategy", F.sha2("compressed", 256).alias("hash"), F.col("saved_tokens").cast("long").alias("saved_tokens"))


#: Sections of a supplier's dictionary, by part; lines rank by price and cost their quantity.
_SECTIONS = ("glossary", "docs", "services", "data_stores", "modules", "technologies", "repo_map")
_ENTRIES = f"""e AS (SELECT project, section, tokens, row_number() OVER (PARTITION BY project, section ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM (SELECT l_suppkey AS project, {list(_SECTIONS)}[l_partkey % 7 + 1] AS section,
        CAST(floor(l_quantity) AS BIGINT) AS tokens, l_extendedprice, l_orderkey, l_linenumber FROM lineitem) t)"""


def dictionary_entries(spark, sf_dir):
    section = F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("l_partkey") % 7 + 1).cast("int"))
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("project"), section.alias("section"), F.floor("l_quantity").cast("long").alias("tokens"), "l_extendedprice", "l_orderkey", "l_linenumber"
    )
    ranked = Window.partitionBy("project", "section").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return lines.select("project", "section", F.row_number().over(ranked).alias("place"), "tokens")


@query("dictionary_budget", f"""WITH RECURSIVE {_ENTRIES}, rules(section, turn, least) AS (VALUES ('glossary', 1, 5), ('docs', 2, 10), ('services', 3, 12), ('data_stores', 4, 10), ('modules', 5, 10)),
    n AS (SELECT project, section, count(*) AS n, sum(tokens) AS tokens FROM e GROUP BY project, section),
    s AS (SELECT project, section, turn, least, n AS length, NULL::BIGINT AS was, 0 AS k FROM n JOIN rules USING (section) UNION ALL SELECT project, section, turn, least, greatest(length * 2 // 3, least), length, k + 1 FROM s WHERE length > least),
    g AS (SELECT s.project, s.section, s.turn, s.k, s.length, sum(tokens) AS saved FROM s JOIN e ON e.project = s.project AND e.section = s.section AND e.place > s.length AND e.place <= s.was GROUP BY ALL),
    w AS (SELECT project, sum(tokens) AS whole FROM n GROUP BY project),
    d AS (SELECT g.*, whole - coalesce(sum(saved) OVER (PARTITION BY g.project ORDER BY turn, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 6000 AS done FROM g JOIN w ON w.project = g.project),
    c AS (SELECT project, section, min(length) AS kept, sum(saved) AS saved FROM d WHERE done GROUP BY project, section)
    SELECT n.project, n.section, n.n, coalesce(kept, n.n) AS kept, coalesce(kept < n.n, false) AS cut, CAST(whole - coalesce(sum(saved) OVER (PARTITION BY n.project), 0) AS BIGINT) AS total FROM n JOIN w ON w.project = n.project LEFT JOIN c ON c.project = n.project AND c.section = n.section""")
def dictionary_budget(spark, sf_dir):
    """Dictionaries of suppliers cut section by section until each fits 6000 tokens."""
    return DI.fitted(dictionary_entries(spark, sf_dir), 6000)


@query("dictionary_level", f"""WITH {_ENTRIES}, most(section, zero, one) AS (VALUES ('technologies', 8, 20), ('repo_map', 10, 25), ('services', 8, 12), ('modules', 6, 20), ('docs', 0, 10)),
    t AS (SELECT project, CAST(sum(CASE WHEN place <= coalesce(zero, 0) THEN tokens ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN place <= coalesce(one, 0) THEN tokens ELSE 0 END) AS BIGINT) AS b, CAST(sum(tokens) AS BIGINT) AS c FROM e LEFT JOIN most USING (section) GROUP BY project)
    SELECT project, CASE WHEN c <= 2100 THEN 2 WHEN b <= 2100 THEN 1 ELSE 0 END AS level, CASE WHEN c <= 2100 THEN c WHEN b <= 2100 THEN b ELSE a END AS tokens FROM t""")
def dictionary_level(spark, sf_dir):
    """The fullest reading of each dictionary that fits 2100 tokens."""
    return DI.reading_level(dictionary_entries(spark, sf_dir), 2100)


#: The same four renderings, put together from strings of rows. Words of a query that look like secrets are masked.
_SECRET = """(length({0}) >= 12 AND len(list_distinct(string_split({0}, ''))) >= 6 AND length({0}) - length(replace({0}, ' ', '')) < 2
    AND list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: -((length({0}) - length(replace({0}, c, ''))) / length({0})) * log2((length({0}) - length(replace({0}, c, ''))) / length({0})))) >= 3)"""
_MASK = "CASE WHEN length({0}) < 16 THEN '«curto»' ELSE left({0}, 4) || '…' || right({0}, 4) END"
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_RENDER_SQL = f"""WITH {BM25_SQL}, h AS (SELECT query_id, doc_id, rank, score, source || '/' || doc_id || '.md' AS path, lang, text, len(string_split(text, chr(10))) AS lines, doc_id % 3 = 0 AS comp,
        {_TOKENS.format("text")} AS tokens, {_TOKENS.format("'## [' || rank || '] ' || source || '/' || doc_id || '.md'")} AS header FROM kr JOIN d USING (doc_id) WHERE rank <= 20),
    u AS (SELECT *, sum(tokens + header) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) + 20 <= 1500 AS kept FROM h),
    mk AS (SELECT item_id AS query_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN {_SECRET.format("w")} THEN {_MASK.format("w")} ELSE w END), ' ') AS masked, text FROM benchmark),
    e AS (SELECT query_id, CASE WHEN length(text) > 96 OR contains(text, ' ') THEN masked ELSE text END AS said FROM mk),
    g AS (SELECT query_id, left(said, 96) || CASE WHEN length(said) > 96 THEN '…' ELSE '' END AS said FROM e),
    a AS (SELECT query_id, CAST(coalesce(sum(tokens) FILTER (kept), 0) AS BIGINT) AS used, count(DISTINCT path) FILTER (kept) AS sources, list_sort(list_distinct(list(path) FILTER (kept))) AS paths, count(*) FILTER (NOT kept) AS lost,
        string_agg('## [' || rank || '] ' || path || ':1-' || lines || ' › ' || lang || CASE WHEN comp THEN '  (comprimido)' ELSE '' END || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank) FILTER (kept) AS md,
        string_agg('  <fragment source="' || {_ESCAPED.format("path")} || '" lines="1-' || lines || '" compressed="' || comp || '">' || chr(10) || '    ' || {_ESCAPED.format("text")} || chr(10) || '  </fragment>' || chr(10), '' ORDER BY rank) FILTER (kept) AS xm,
        string_agg('  [' || rank || '] ' || path || ':1-' || lines || ' › ' || lang || chr(10) || '       score ' || printf('%.4f', score) || ' · ' || tokens || ' tokens · via keyword' || CASE WHEN comp THEN ', comprimido por ' || chr(39) || 'prune' || chr(39) ELSE '' END || chr(10), '' ORDER BY rank) FILTER (kept) AS ex,
        string_agg('    ' || left(CAST(doc_id AS VARCHAR), 14) || '  budget: ' || tokens, chr(10) ORDER BY rank) FILTER (NOT kept AND late <= 5) AS examples,
        list({{'document_path': path, 'lines': [1, lines], 'symbol': lang, 'score': round(score, 6), 'tokens': tokens, 'compressed': comp, 'strategy': 'prune', 'reason': 'keyword', 'content': text}} ORDER BY rank) FILTER (kept) AS fragments,
        list({{'id': CAST(doc_id AS VARCHAR), 'why': 'budget: ' || tokens}} ORDER BY rank) FILTER (NOT kept AND late <= 5) AS shown
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kept ORDER BY rank) AS late FROM u) t GROUP BY query_id),
    pk AS (SELECT g.query_id, said, coalesce(used, 0) AS used, coalesce(sources, 0) AS sources, coalesce(paths, []) AS paths, coalesce(lost, 0) AS lost, coalesce(md, '') AS md, coalesce(xm, '') AS xm, coalesce(ex, '') AS ex,
        coalesce(examples, '') AS examples, coalesce(fragments, []) AS fragments, coalesce(shown, []) AS shown FROM g LEFT JOIN a USING (query_id)),
    r AS (SELECT query_id, 'markdown' AS format, '# Contexto — ' || said || chr(10) || chr(10) || md || '---' || chr(10) || sources || ' fonte(s) · ~' || used || ' / 1500 tokens' || CASE WHEN lost > 0 THEN ' · ' || lost || ' candidatos descartados' ELSE '' END AS rendered FROM pk
        UNION ALL SELECT query_id, 'xml', '<context query="' || replace({_ESCAPED.format("said")}, '"', '&quot;') || '">' || chr(10) || xm || '  <meta tokens="' || used || '" budget="1500" sources="' || sources || '" />' || chr(10) || '</context>' FROM pk
        UNION ALL SELECT query_id, 'json', CAST(to_json({{'query': said, 'intent': 'lookup', 'estimated_tokens': used, 'budget': 1500, 'sources': paths, 'fragments': fragments, 'dropped': lost,
            'reasons': CASE WHEN lost > 0 THEN [{{'n': lost, 'why': 'budget'}}] ELSE [] END, 'examples': shown}}) AS VARCHAR) FROM pk
        UNION ALL SELECT query_id, 'explain', rtrim('Intenção detectada: lookup' || chr(10) || 'Orçamento: ' || used || ' / 1500 tokens' || chr(10) || chr(10) || 'INCLUÍDOS:' || chr(10) || ex
            || CASE WHEN lost > 0 THEN chr(10) || 'DESCARTADOS (' || lost || '):' || chr(10) || '  ' || lpad(CAST(lost AS VARCHAR), 4, ' ') || '  budget' || chr(10) || chr(10) || '  exemplos:' || chr(10) || examples ELSE '' END, chr(10)) FROM pk)
    SELECT query_id, format, CAST(length(rendered) AS BIGINT) AS chars, sha256(rendered) AS hash FROM r"""


@query("rendered_packs", _RENDER_SQL)
def rendered_packs(spark, sf_dir):
    """Keyword hits under 1500 tokens as Markdown, XML, JSON and an explanation, with what the budget left out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    hits = keyword(spark, sf_dir, 20).join(docs, "doc_id")
    header = T.token_count(F.format_string("## [%d] %s/%d.md", "rank", "source", "doc_id"))
    rows = hits.select(
        "query_id", "doc_id", F.col("rank").alias("place"), F.format_string("%s/%d.md", "source", "doc_id").alias("path"), F.lit(1).alias("first_line"), F.size(F.split("text", "\n", -1)).alias("last_line"),
        F.col("lang").alias("name"), T.token_count(F.col("text")).cast("long").alias("tokens"), "score", (F.col("doc_id") % 3 == 0).alias("compressed"), F.lit("prune").alias("strategy"),
        F.lit("keyword").alias("reason"), "text", header.alias("header"),
    )
    rows = cut(rows)  # twenty hits of each query of the batch, rendered four times
    kept = C.hard_cap(rows, 1500, 20).where("NOT shortened")
    lost = rows.join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    lost = lost.select("query_id", F.col("doc_id").alias("id"), F.concat(F.lit("budget: "), F.col("tokens").cast("string")).alias("why"), "place")
    packs = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("lookup").alias("intent"), F.lit(1500).alias("budget"))
    forms = {"markdown": R.markdown(packs, kept, lost), "xml": R.xml(packs, kept), "json": R.json(packs, kept, lost), "explain": R.explain(packs, kept, lost)}
    each = [df.select("query_id", F.lit(name).alias("format"), F.length("rendered").cast("long").alias("chars"), F.sha2("rendered", 256).alias("hash")) for name, df in forms.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
