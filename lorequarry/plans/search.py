"""Search queries: keyword, vector, fusion, rerank, diversity, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.functions import stats
from lorequarry.functions import text as T
from lorequarry.operators import embedding
from lorequarry.operators import evaluation as EV
from lorequarry.operators import index as IX
from lorequarry.operators import search as S
from lorequarry.plans.registry import query
from lorequarry.session import cut, read_table

_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"

BM25_SQL = f"""
    d AS (SELECT doc_id, source, lang, text, {_WORDS.format("text")} AS tokens FROM documents),
    q AS (SELECT item_id AS query_id, text AS qtext, unnest(list_distinct({_WORDS.format("text")})) AS term FROM benchmark),
    stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(tokens) AS DOUBLE)) AS avgdl FROM d),
    p AS (SELECT doc_id, CAST(len(tokens) AS DOUBLE) AS dl, unnest(tokens) AS term FROM d),
    tf AS (SELECT term, doc_id, dl, CAST(count(*) AS DOUBLE) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
    w AS (SELECT term, doc_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w
          FROM tf JOIN df USING (term), stats),
    kw AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM w JOIN q USING (term) GROUP BY query_id, doc_id),
    kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kw)"""


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def keyword(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return S.ranked(S.bm25(read_table(spark, sf_dir, "documents"), S.query_terms(queries_of(spark, sf_dir)), most=k), k)


@query("keyword_bm25", f"WITH {BM25_SQL} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM kr WHERE rank <= 10")
def keyword_bm25(spark, sf_dir):
    return keyword(spark, sf_dir).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query("keyword_hydrated", f"""WITH {BM25_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, d.source || '/' || doc_id || '.md' AS rel_path, lang
    FROM kr JOIN d USING (doc_id) WHERE rank <= 5""")
def keyword_hydrated(spark, sf_dir):
    """Hits meet their documents after the cut, so that texts are not carried through the ranking."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.format_string("%s/%d.md", "source", "doc_id").alias("rel_path"))
    return keyword(spark, sf_dir, 5).join(docs, "doc_id").select("query_id", "rank", "doc_id", "rel_path", "lang")


@query("keyword_filtered", f"""WITH {BM25_SQL.replace("FROM documents", "FROM documents WHERE lang = 'en' AND source ILIKE 'SRC1%'")}
    SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM kr WHERE rank <= 10""")
def keyword_filtered(spark, sf_dir):
    """Filters stand below the ranking: a glob is case-insensitive, as the reference behaviour has it."""
    docs = read_table(spark, sf_dir, "documents").where((F.col("lang") == "en") & F.col("source").ilike("SRC1%"))
    return S.ranked(S.bm25(docs, S.query_terms(queries_of(spark, sf_dir)), most=10), 10).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query("keyword_weighted", r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term, 1.0 AS w FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\p{L}\p{N}]+')), 4.0 FROM documents
    UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(source), '[\p{L}\p{N}]+')), 0.5 FROM documents),
    q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark),
    l AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS dl FROM f GROUP BY doc_id), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS a FROM l),
    tf AS (SELECT term, doc_id, CAST(sum(w) AS DOUBLE) AS tf FROM f WHERE term IN (SELECT term FROM q) GROUP BY term, doc_id), df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
    s AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (term) JOIN l USING (doc_id) JOIN q USING (term), st GROUP BY query_id, doc_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT query_id, doc_id, rank FROM r WHERE rank <= 10""")
def keyword_weighted(spark, sf_dir):
    """Content, the first line as a heading (weight 4) and the source as context (0.5)."""
    docs = read_table(spark, sf_dir, "documents").withColumn("heading", F.substring_index("text", "\n", 1))
    return S.ranked(S.bm25_fields(docs, S.query_terms(queries_of(spark, sf_dir)), {"text": 1.0, "heading": 4.0, "source": 0.5}), 10).select("query_id", "doc_id", "rank")


@query("keyword_min_score", f"WITH {BM25_SQL} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM kr WHERE rank <= 10 AND score >= 8")
def keyword_min_score(spark, sf_dir):
    return S.at_least(keyword(spark, sf_dir), 8.0).select("query_id", "doc_id", "rank")


@query("scoped_counts", """WITH s AS (SELECT doc_id, coalesce(source, '') AS own, CASE doc_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'project:' || lang ELSE 'here' END AS said FROM documents),
    k AS (SELECT *, CASE WHEN said = 'all' THEN '*' WHEN said LIKE 'project:%' THEN replace(said, 'project:', 'l/') ELSE 's/' || own END AS p FROM s),
    n AS (SELECT '*' AS p, count(*) AS docs FROM documents UNION ALL SELECT 'l/' || lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 's/' || source, count(*) FROM documents GROUP BY source)
    SELECT k.doc_id, CASE left(k.p, 1) WHEN '*' THEN 'all' WHEN 'l' THEN 'project' ELSE 'current' END AS kind, n.docs FROM k JOIN n USING (p)""")
def scoped_counts(spark, sf_dir):
    """Per document, how many documents the scope that it states admits: all, those of a language, or those of its source."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "lang")
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.lit("all")).when(k == 1, F.concat(F.lit("project:"), "lang")).otherwise(F.lit("here"))
    asked = docs.select("doc_id", "source", S.scope(said).alias("s")).select("doc_id", "s.kind", F.when(F.col("s.kind") == "current", F.col("source")).otherwise(F.col("s.project")).alias("name"))
    kinds = F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("project").alias("kind"), F.col("lang").alias("name")), F.struct(F.lit("current").alias("kind"), F.col("source").alias("name"))))
    sizes = docs.select(kinds.alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("docs"))
    met = (asked["kind"] == sizes["kind"]) & asked["name"].eqNullSafe(sizes["name"])
    return asked.join(sizes, met).select("doc_id", asked["kind"], "docs")


@query("prefix_terms", """WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS t FROM documents),
    q AS (SELECT item_id AS query_id, list_last(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark)
    SELECT query_id, substr(term, 1, 4) AS prefix, count(DISTINCT doc_id) AS docs FROM q JOIN d ON substr(t, 1, 4) = substr(term, 1, 4) WHERE length(term) >= 4 GROUP BY ALL""")
def prefix_terms(spark, sf_dir):
    """The last term of a query is a prefix: equality of leading characters, so it joins rather than scans pairs."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(T.words(F.col("text")), lambda t: F.substring(t, 1, 4)))).alias("prefix"))
    last = queries_of(spark, sf_dir).select("query_id", F.try_element_at(T.words(F.col("text")), F.lit(-1)).alias("term")).where("length(term) >= 4")
    return last.select("query_id", F.substring("term", 1, 4).alias("prefix")).join(docs, "prefix").groupBy("query_id", "prefix").agg(F.countDistinct("doc_id").alias("docs"))


_UNIT = "list_transform({v}, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform({v}, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
VECTOR_SQL = f"""
    u AS (SELECT vec_id, label, {_UNIT.format(v="embedding")} AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, u.vec_id, u.label, round({_DOT.format(a="u.v", b="q.v")}, 6) AS score FROM u q JOIN u ON true WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a query against all rows."""
    return read_table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("vector_topk", f"WITH {VECTOR_SQL} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings")
    return S.vector_top(rows, _asked(spark, sf_dir), 10).select("query_id", "vec_id", "rank", "score")


@query("vector_filtered", f"WITH {VECTOR_SQL.replace('FROM u q JOIN u ON true WHERE', 'FROM u q JOIN u ON true WHERE u.label IN (1, 3) AND')} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= 10")
def vector_filtered(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3))
    return S.vector_top(rows, _asked(spark, sf_dir), 10).select("query_id", "vec_id", "rank", "score")


@query("vector_two_stage")
def vector_two_stage(spark, sf_dir):
    """Coarse selection on quantised leading components, exact order among what it kept; recall is held in tests."""
    return S.two_stage(read_table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 10).select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))


@query("cosine_by_label", """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    c AS (SELECT label, unnest(range(1, 65)) AS k, v FROM u), m AS (SELECT label, k, avg(v[k]) AS x FROM c GROUP BY label, k)
    SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 4) AS cosine FROM m a JOIN m b USING (k) GROUP BY ALL""")
def cosine_by_label(spark, sf_dir):
    """Cosines between the mean vectors of labels."""
    parts = read_table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    a, b = parts.select(F.col("label").alias("a"), "k", F.col("x").alias("x")), parts.select(F.col("label").alias("b"), "k", F.col("x").alias("y"))
    return a.join(b, "k").groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))), 4).alias("cosine"))


#: The semantic leg: cosines of hashing vectors of queries and documents (``operators.embedding.Hashing``), stated over slots.
SEMANTIC_SQL = r"""
    tk AS (SELECT doc_id AS id, 'd' AS kind, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS t FROM documents
           UNION ALL SELECT item_id, 'q', list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') FROM benchmark),
    h1 AS (SELECT id, kind, CAST('0x' || left(md5(w), 15) AS BIGINT) AS h FROM (SELECT id, kind, unnest(t) AS w FROM tk)),
    h2 AS (SELECT id, kind, CAST('0x' || left(md5(w), 15) AS BIGINT) AS h FROM (SELECT id, kind, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS w FROM tk)),
    sl AS (SELECT id, kind, h % 64 AS slot, 1.0 AS w FROM h1 UNION ALL SELECT id, kind, (h >> 16) % 64, 0.5 FROM h1 UNION ALL SELECT id, kind, h % 64, 0.75 FROM h2
           UNION ALL SELECT id, kind, 0, 1.0 FROM tk WHERE len(t) = 0),
    sv AS (SELECT id, kind, slot, CAST(sum(w) AS DOUBLE) AS w FROM sl GROUP BY ALL),
    sn AS (SELECT id, kind, sqrt(sum(w * w)) AS n FROM sv GROUP BY ALL),
    sd AS (SELECT id, kind, slot, w / n AS w FROM sv JOIN sn USING (id, kind)),
    c AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(coalesce(x.w * y.w, 0)), 6) AS score FROM sn q JOIN sn d ON q.kind = 'q' AND d.kind = 'd'
          LEFT JOIN sd x ON x.kind = 'q' AND x.id = q.id LEFT JOIN sd y ON y.kind = 'd' AND y.id = d.id AND y.slot = x.slot GROUP BY q.id, d.id),
    cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c)"""

FUSED_SQL = f"""{SEMANTIC_SQL},
    rk AS (SELECT 'keyword' AS source, query_id, doc_id, rank FROM kr WHERE rank <= 30 UNION ALL SELECT 'semantic', query_id, doc_id, rank FROM cr WHERE rank <= 30),
    fu AS (SELECT query_id, doc_id, round(sum(CASE source WHEN 'keyword' THEN 0.8 ELSE 1.0 END / (60 + rank)), 8) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS matched_by FROM rk GROUP BY query_id, doc_id)"""


def semantic(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The nearest documents of each query by the vectors of one embedder."""
    model = embedding.Hashing(64)
    hits = S.vector_top(model.documents(read_table(spark, sf_dir, "documents")), model.queries(queries_of(spark, sf_dir)), k)
    return hits.select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")


@query("semantic_search", f"WITH {SEMANTIC_SQL} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM cr WHERE rank <= 10")
def semantic_search(spark, sf_dir):
    return semantic(spark, sf_dir).select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


def legs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The first thirty of each query by keyword and by vector, materialised: a few thousand rows that several readers share."""
    return {"keyword": cut(keyword(spark, sf_dir, 30)), "semantic": cut(semantic(spark, sf_dir, 30))}


def fused(spark: SparkSession, sf_dir: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    rows = [df.select(F.lit(source).alias("source"), "query_id", "doc_id", "rank") for source, df in (held or legs(spark, sf_dir)).items()]
    return S.rrf(rows[0].unionByName(rows[1]), {"keyword": S.KEYWORD_WEIGHT, "semantic": S.SEMANTIC_WEIGHT})


@query("rrf_fusion", f"WITH {BM25_SQL}, {FUSED_SQL} SELECT query_id, doc_id, round(score, 6) AS score, matched_by FROM fu")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"), "matched_by")


RERANK_SQL = r"""
    k AS (SELECT fu.query_id, fu.doc_id, matched_by, source, fu.score
            * CASE WHEN regexp_matches(qt.text, '(?i)\?|^\s*(como|o que|oque|por que|porque|quando|onde|qual|quais|quem)\b') AND doc_id % 2 = 0 THEN 1.2 ELSE 1.0 END
            * CASE WHEN regexp_matches(qt.text, '[a-z][A-Z]|::|\(\)|_[a-z]|\.[a-z]+\(') AND doc_id % 2 = 1 THEN 1.2 ELSE 1.0 END
            * CASE WHEN n_chars < 128 THEN 0.8 ELSE 1.0 END * CASE WHEN doc_id % 10 = 3 THEN 0.45 WHEN doc_id % 10 = 7 THEN 0.7 ELSE 1.0 END AS s
          FROM fu JOIN documents USING (doc_id) JOIN benchmark qt ON qt.item_id = query_id),
    rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 7) DESC, doc_id) AS rank FROM k)"""


def reranked(spark: SparkSession, sf_dir: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """Fused hits times the declared factors; kinds and tiers of documents derive from their ids."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    tier = F.when(F.col("doc_id") % 10 == 3, "work").when(F.col("doc_id") % 10 == 7, "test").otherwise("knowledge")
    kind = F.when(F.col("doc_id") % 2 == 0, "doc").otherwise("code")
    factor = S.rerank_factor(F.col("text"), F.lit(None).cast("string"), kind, F.col("n_chars") / 4, F.lit(False), tier)
    hits = fused(spark, sf_dir, held).join(docs, "doc_id").join(F.broadcast(queries_of(spark, sf_dir)), "query_id")  # the batch of queries
    return S.ranked(hits.withColumn("score", F.round(F.col("score") * factor, 7)), 1 << 30)


@query("hybrid_rerank", f"WITH {BM25_SQL}, {FUSED_SQL}, {RERANK_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(s, 7) AS score, matched_by FROM rr WHERE rank <= 10")
def hybrid_rerank(spark, sf_dir):
    return reranked(spark, sf_dir).where("rank <= 10").select("query_id", "rank", "doc_id", "score", "matched_by")


@query("diversify_per_source", f"""WITH {BM25_SQL}, {FUSED_SQL}, {RERANK_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 3 AS over FROM rr)
    SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY over, rank) AS INTEGER) AS place FROM o""")
def diversify_per_source(spark, sf_dir):
    return S.diversify(reranked(spark, sf_dir), "source").select("query_id", "doc_id", "rank", "place")


EVAL_SQL = """
    rel AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    h AS (SELECT kr.query_id, kr.rank, kr.doc_id FROM kr JOIN rel USING (query_id, doc_id) WHERE kr.rank <= 10),
    n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
    m AS (SELECT n.query_id, n.n, min(h.rank) AS first, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg FROM n LEFT JOIN h USING (query_id) GROUP BY ALL),
    i AS (SELECT query_id, first, dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))) AS ndcg FROM m)"""


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id) of the documents that hold a passage verbatim, materialised.

    A passage's longest inner word finds the candidates within a document's own row, so texts are read once and not moved.
    The first and last word may be cut inside a document's word, so neither serves; shorter passages meet every document.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    words = lambda text: F.regexp_extract_all(text, F.lit(T.WORD), F.lit(0))
    inner = F.when(F.size("ws") > 2, F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 2, F.lit(1))))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = cut(queries_of(spark, sf_dir).select("query_id", F.col("text").alias("passage"), words(F.col("text")).alias("ws")).select("query_id", "passage", longest.alias("w")))
    anchors = F.broadcast(asked.agg(F.collect_set("w").alias("anchors")))  # one row, a word per passage of the batch
    met = docs.crossJoin(anchors).select("doc_id", "text", F.explode(F.array_intersect(words(F.col("text")), "anchors")).alias("w"))
    found = met.join(F.broadcast(asked), "w").where("contains(text, passage)").select("query_id", "doc_id")  # the batch of queries
    short = asked.where("w IS NULL")
    if not short.isEmpty():
        found = found.unionByName(docs.join(F.broadcast(short), F.expr("contains(text, passage)")).select("query_id", "doc_id"))
    return cut(found.distinct())


def judged(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None, rel: DataFrame | None = None) -> DataFrame:
    """Per answerable query: rank of the first relevant hit, and nDCG over the first ten."""
    rel = relevance(spark, sf_dir) if rel is None else rel
    hits = (keyword(spark, sf_dir) if hits is None else hits).join(rel, ["query_id", "doc_id"]).select("query_id", "rank")
    per = rel.groupBy("query_id").agg(F.count("*").alias("n")).join(hits, "query_id", "left").groupBy("query_id", "n").agg(F.min("rank").alias("first"), F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return per.select("query_id", "first", (F.col("dcg") / ideal).alias("ndcg"))


@query("eval_hit_mrr_ndcg", f"""WITH {BM25_SQL}, {EVAL_SQL} SELECT count(*) AS cases, count(*) FILTER (first <= 5) AS hits, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5,
    round(avg(coalesce(1.0 / first, 0)), 4) AS mrr, round(avg(ndcg), 4) AS ndcg_at_10 FROM i""")
def eval_hit_mrr_ndcg(spark, sf_dir):
    hit = F.coalesce(F.col("first") <= 5, F.lit(False))
    return judged(spark, sf_dir).agg(F.count("*").alias("cases"), F.count_if(hit).alias("hits"), F.round(F.avg(hit.cast("double")), 4).alias("recall_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg_at_10"))


@query("wilson_interval", f"""WITH {BM25_SQL}, {EVAL_SQL}, t AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (first <= 5) / CAST(count(*) AS DOUBLE) AS p, {stats.Z95} AS z FROM i)
    SELECT round(greatest(0.0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 4) AS low,
           round(least(1.0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 4) AS high FROM t""")
def wilson_interval(spark, sf_dir):
    counted = judged(spark, sf_dir).agg(F.count_if(F.coalesce(F.col("first") <= 5, F.lit(False))).alias("hits"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return counted.select(F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("no_answer_threshold", f"""WITH {BM25_SQL}, {EVAL_SQL}, t1 AS (SELECT query_id, score FROM kr WHERE rank = 1),
    good AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM t1 JOIN i USING (query_id) WHERE first <= 5),
    lim AS (SELECT score AS threshold FROM good WHERE r = CAST(floor(0.10 * (n - 1)) AS BIGINT) + 1)
    SELECT round(threshold, 4) AS threshold, count(*) AS no_answer_cases, count(*) FILTER (t1.score >= threshold) AS false_positives
    FROM benchmark b LEFT JOIN t1 ON t1.query_id = b.item_id, lim WHERE b.item_id NOT IN (SELECT query_id FROM rel) GROUP BY threshold""")
def no_answer_threshold(spark, sf_dir):
    """Unanswerable queries whose best score reaches the tenth percentile of right answers."""
    hits, rel = cut(keyword(spark, sf_dir)), relevance(spark, sf_dir)
    first, judged_ = hits.where("rank = 1").select("query_id", "score"), judged(spark, sf_dir, hits, rel)
    good = first.join(judged_.where("first <= 5"), "query_id").agg(F.array_sort(F.collect_list("score")).alias("s"))  # a score per query of the batch
    limit = good.select(F.element_at("s", (F.floor(0.10 * (F.size("s") - 1)) + 1).cast("int")).alias("threshold"))
    none = queries_of(spark, sf_dir).join(rel, "query_id", "left_anti").select("query_id").join(first, "query_id", "left")
    return none.join(F.broadcast(limit)).groupBy(F.round("threshold", 4).alias("threshold")).agg(F.count("*").alias("no_answer_cases"), F.count_if(F.col("score") >= F.col("threshold")).alias("false_positives"))


def _index_sql(documents: str, weight: float) -> str:
    """BM25 over text and source, without diacritics; the last term of a query is a prefix. ``documents`` states the rows indexed."""
    words = r"regexp_extract_all(lower(strip_accents(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"
    return f"""WITH d AS (SELECT doc_id, {words.format("text")} AS a, {words.format("source")} AS b FROM ({documents})),
        l AS (SELECT doc_id, CAST(len(a) + len(b) AS DOUBLE) AS dl FROM d), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM l),
        p AS (SELECT doc_id, term, CAST(sum(w) AS DOUBLE) AS tf FROM (SELECT doc_id, unnest(a) AS term, 1.0 AS w FROM d UNION ALL SELECT doc_id, unnest(b), {weight} FROM d) GROUP BY ALL),
        w AS (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS t, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), 1) AS pos FROM benchmark),
        s AS (SELECT item_id AS query_id, lower(t) AS word, min(pos) AS pos FROM w GROUP BY ALL),
        u AS (SELECT DISTINCT query_id, lower(strip_accents(word)) AS token, pos = max(pos) OVER (PARTITION BY query_id) AND length(word) > 1 AS prefix FROM s),
        k AS (SELECT DISTINCT token, prefix FROM u),
        m AS (SELECT token, prefix, doc_id, sum(tf) AS tf FROM k JOIN p ON term = token OR (prefix AND starts_with(term, token)) GROUP BY ALL),
        f AS (SELECT token, prefix, CAST(count(*) AS DOUBLE) AS df FROM m GROUP BY ALL),
        r AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
              FROM u JOIN m USING (token, prefix) JOIN f USING (token, prefix) JOIN l USING (doc_id), st GROUP BY query_id, doc_id),
        o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r)
        SELECT query_id, doc_id, rank, score FROM o WHERE rank <= 10"""


def _kept(spark: SparkSession, docs: DataFrame) -> IX.Index:
    index = IX.Index(spark, IX.folder(spark, "index"), ("text", "source"))
    index.apply(docs)
    return index


@query("index_search", _index_sql("SELECT doc_id, text, source FROM documents", 0.5))
def index_search(spark, sf_dir):
    """Searches a kept index: postings are written once and only asked buckets are read."""
    index = _kept(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return index.search(queries_of(spark, sf_dir), 10, weights={"source": 0.5}).select("query_id", "doc_id", "rank", "score")


@query("index_maintained", _index_sql("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'nouveau ' || coalesce(text, '') ELSE text END AS text, source FROM documents WHERE doc_id % 10 <> 9", 1.0))
def index_maintained(spark, sf_dir):
    """A batch of edits and a batch of deletions go into segments of their own, and are merged; only edited documents are tokenised again."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    index = _kept(spark, docs)
    index.apply(docs.where("doc_id % 6 = 0").withColumn("text", F.concat(F.lit("nouveau "), F.coalesce("text", F.lit("")))))
    index.apply(None, docs.where("doc_id % 10 = 9").select("doc_id"))
    index.merge()
    return index.search(queries_of(spark, sf_dir)).select("query_id", "doc_id", "rank", "score")


@query("index_phrases", r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}]+') AS a FROM documents),
    l AS (SELECT doc_id, CAST(len(a) AS DOUBLE) AS dl, ' ' || array_to_string(a, '  ') || ' ' AS s FROM d), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM l),
    q AS (SELECT item_id AS query_id, ' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')[2:4], '  ') || ' ' AS phrase FROM benchmark
          WHERE item_id % 5 <> 0 AND len(regexp_extract_all(text, '[\p{L}\p{N}]+')) >= 4),
    m AS (SELECT query_id, doc_id, dl, (length(s) - length(replace(s, phrase, ''))) / length(phrase) AS tf FROM q JOIN l ON contains(s, phrase)),
    f AS (SELECT query_id, CAST(count(*) AS DOUBLE) AS df FROM m GROUP BY query_id),
    r AS (SELECT query_id, doc_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)), 6) AS score FROM m JOIN f USING (query_id), st)
    SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, round(score, 4) AS score FROM r
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""")
def index_phrases(spark, sf_dir):
    """Three words of each passage as a phrase, ranked from positions; every fifth query has an open quote, which gives no rows."""
    index = IX.Index(spark, IX.folder(spark, "index"))
    index.apply(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.slice(IX.tokens(F.col("text")), 2, 3)
    asked = queries_of(spark, sf_dir).where(F.size(IX.tokens(F.col("text"))) >= 4).select("query_id", F.concat(F.lit('"'), F.array_join(words, " "), F.when(F.col("query_id") % 5 != 0, '"').otherwise("")).alias("text"))
    return index.search(asked, raw=True, apart=True).select("query_id", "doc_id", "rank", stats.rounded(F.col("score"), 4).alias("score"))


#: Every passage as a case in three modes: hits, first places, gains, and what passages without a document are shown.
_MODES_SQL = f"""{BM25_SQL}, {FUSED_SQL}, {RERANK_SQL},
    rel AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    need AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
    hm AS (SELECT 'keyword' AS mode, query_id, doc_id, rank, score FROM kr WHERE rank <= 10 UNION ALL SELECT 'semantic', query_id, doc_id, rank, score FROM cr WHERE rank <= 10
           UNION ALL SELECT 'hybrid', query_id, doc_id, rank, round(s, 7) FROM rr WHERE rank <= 10),
    cs AS (SELECT item_id AS query_id, CASE WHEN length(text) > 400 THEN 'long' ELSE 'short' END AS class, CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, mode
           FROM benchmark, (VALUES ('keyword'), ('semantic'), ('hybrid')) m(mode)),
    gn AS (SELECT mode, query_id, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM hm JOIN rel USING (query_id, doc_id) GROUP BY ALL),
    jd AS (SELECT cs.*, need.n, gn.first, coalesce(gain, 0) / list_sum(list_transform(range(1, least(need.n, 10) + 1), lambda r: 1 / log2(r + 1))) AS ndcg, t.score AS top, need.n IS NOT NULL AND coalesce(gn.first <= 5, false) AS hit
           FROM cs LEFT JOIN need USING (query_id) LEFT JOIN gn USING (mode, query_id) LEFT JOIN (SELECT * FROM hm WHERE rank = 1) t USING (mode, query_id))"""


def case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as cases of three modes; a passage that no document holds has no answer."""
    asked = queries_of(spark, sf_dir)
    level = F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (F.col("query_id") % 3 + 1).cast("int"))
    cases = asked.select("query_id", F.when(F.length("text") > 400, "long").otherwise("short").alias("class"), level.alias("difficulty"))
    held = legs(spark, sf_dir)
    modes = held | {"hybrid": reranked(spark, sf_dir, held)}
    hits = [df.where("rank <= 10").select(F.lit(mode).alias("mode"), "query_id", "rank", "doc_id", "score") for mode, df in modes.items()]
    return cut(EV.judged(cases, relevance(spark, sf_dir), hits[0].unionByName(hits[1]).unionByName(hits[2]), tuple(modes)))  # a row per case and mode


@query("eval_modes", f"""WITH {_MODES_SQL}, th AS (SELECT mode, top AS threshold FROM (SELECT mode, top, row_number() OVER (PARTITION BY mode ORDER BY top) AS r, count(*) OVER (PARTITION BY mode) AS n FROM jd WHERE hit AND top IS NOT NULL) t
        WHERE r = (n - 1) // 10 + 1),
    ag AS (SELECT mode, threshold, CAST(count(n) AS DOUBLE) AS m, CAST(count(*) FILTER (hit) AS DOUBLE) AS k, avg(CASE WHEN n IS NOT NULL THEN coalesce(1.0 / first, 0) END) AS mrr, avg(ndcg) FILTER (n IS NOT NULL) AS ndcg,
        count(*) FILTER (n IS NULL) AS none, count(*) FILTER (n IS NULL AND top >= threshold) AS fp FROM jd LEFT JOIN th USING (mode) GROUP BY ALL), z AS (SELECT *, k / m AS p, {stats.Z95} AS z FROM ag)
    SELECT mode, CAST(m AS BIGINT) AS cases, CAST(k AS BIGINT) AS hits, round(p, 4) AS recall_at_5, round(mrr, 4) AS mrr, round(ndcg, 4) AS ndcg_at_10, round(threshold, 4) AS threshold, none AS no_answer_cases, fp AS false_positives,
        round(greatest(0, (p + z * z / (2 * m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)), 4) AS low, round(least(1, (p + z * z / (2 * m) + z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)), 4) AS high FROM z""")
def eval_modes(spark, sf_dir):
    rows = EV.mode_metrics(case_results(spark, sf_dir))
    return rows.select("mode", "cases", "hits", *[F.round(c, 4).alias(c) for c in ("recall_at_5", "mrr", "ndcg_at_10", "threshold", "low", "high")], "no_answer_cases", "false_positives")


@query("eval_mode_groups", f"""WITH {_MODES_SQL} SELECT mode, 'class' AS "by", class AS key, count(*) FILTER (hit) AS hits, count(*) AS cases FROM jd WHERE n IS NOT NULL GROUP BY mode, class
    UNION ALL SELECT mode, 'difficulty', difficulty, count(*) FILTER (hit), count(*) FROM jd WHERE n IS NOT NULL GROUP BY mode, difficulty""")
def eval_mode_groups(spark, sf_dir):
    return EV.mode_groups(case_results(spark, sf_dir))


@query("eval_failures", f"WITH {_MODES_SQL} SELECT mode, query_id, CAST(first AS INTEGER) AS first FROM jd WHERE n IS NOT NULL AND NOT hit")
def eval_failures(spark, sf_dir):
    return EV.failures(case_results(spark, sf_dir)).select("mode", "query_id", F.col("first").cast("int").alias("first"))
