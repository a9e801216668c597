"""Keyword, vector and hybrid search for a batch of queries, as DataFrame operators."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.session import cut

K1, B, FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
#: Pairs of queries and terms that every task of keyword search may hold; more of them are joined by a shuffle.
BROADCAST_TERMS = 100_000
#: Postings that a task of keyword search scores at once, whole documents at a time.
POSTINGS = 1 << 18
#: Queries of one block of vector search, which every task holds; a larger batch is searched block by block.
QUERIES = 4096
#: Scores that a task of vector search holds at once: a batch of rows meets its queries in tiles of so many.
CELLS = 1 << 20
KEYWORD_WEIGHT, SEMANTIC_WEIGHT = 0.8, 1.0
#: Fixed factors of the deterministic rerank.
SYMBOL, DOC_QUESTION, CODE_IDENTIFIER, SHORT, REDACTED = 1.5, 1.2, 1.2, 0.8, 0.9
WORK_WEIGHT, TEST_WEIGHT = 0.45, 0.7


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))


def bm25(docs: DataFrame, terms: DataFrame, prefix: bool = False, most: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): BM25 of every document that holds a term; OR semantics.

    Only postings of asked terms are built, counted within each document's row, and move once, by document. A task then adds
    up the scores of its documents in tiles; with ``most`` it hands on only so many of the best of each query, ties to the smaller id.
    Each document also counts under the number -1, which gives the totals. Beyond BROADCAST_TERMS pairs of queries and terms
    both steps are shuffled joins, with the same scores. With ``prefix`` a term stands for every token that starts with it
    (terms are cut at eight characters, so they meet by equality).
    """
    terms = cut(terms.where("term <> ''").select("query_id", "term"))
    if terms.count() > BROADCAST_TERMS:
        return _joined(docs, terms, prefix)
    pairs = terms.toArrow().combine_chunks()
    asked, queries = pairs.column("term").unique(), pairs.column("query_id").unique()
    number = pc.index_in(pairs.column("term"), asked).to_numpy()
    order = np.argsort(number, kind="stable")
    of = pc.index_in(pairs.column("query_id"), queries, skip_nulls=False).to_numpy()[order]
    ids = docs.schema["doc_id"].dataType.simpleString()
    tokens = docs.select("doc_id", T.words(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"))
    posts = tokens.mapInArrow(_postings(asked, prefix), f"doc_id {ids}, dl long, term int, tf long")
    held = cut(posts.repartition("doc_id").groupBy("doc_id", "dl", "term").agg(F.sum("tf").cast("double").alias("tf")))
    n, avg = held.where("term = -1").agg(F.sum("tf"), F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).first()
    df, found = np.zeros(len(asked)), held.where("term >= 0").groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row per asked term
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    idf = np.maximum(np.log(((n or 0) - df + 0.5) / (df + 0.5)), FLOOR)
    firsts = np.searchsorted(number[order], np.arange(len(asked) + 1))
    rows = held.where("term >= 0").sortWithinPartitions("doc_id")
    return rows.mapInArrow(_summed(idf, avg or 1.0, firsts, of, queries, most), f"query_id {terms.schema['query_id'].dataType.simpleString()}, doc_id {ids}, score double")


def _postings(asked: pa.ChunkedArray, prefix: bool):
    """(doc_id, tokens) to (doc_id, dl, term, tf): numbers of asked terms and their counts in each row, and one -1 a row."""
    asked = asked.combine_chunks() if isinstance(asked, pa.ChunkedArray) else asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = pc.list_value_length(lists).to_numpy().astype(np.int64)
            flat = lists.flatten()
            met = pc.index_in(pc.utf8_slice_codeunits(flat, 0, 8) if prefix else flat, asked).fill_null(-1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            key, tf = np.unique((row * len(asked) + met)[met >= 0], return_counts=True)
            row, term = np.divmod(key, max(len(asked), 1))
            row, term, tf = (np.concatenate(x) for x in ((row, np.arange(len(size))), (term, np.full(len(size), -1)), (tf, np.ones(len(size), dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(size[row]), pa.array(term.astype(np.int32)), pa.array(tf)], ["doc_id", "dl", "term", "tf"])

    return run


def _summed(idf: np.ndarray, avg: float, firsts: np.ndarray, of: np.ndarray, queries, most: int | None):
    """(doc_id, dl, term, tf) in the order of documents to (query_id, doc_id, score); the queries of a term lie in ``of`` from its first place on."""
    queries = queries.combine_chunks() if isinstance(queries, pa.ChunkedArray) else queries

    def scored(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        dl, term, tf = (table.column(c).to_numpy() for c in ("dl", "term", "tf"))
        docs = table.column("doc_id").combine_chunks()
        now, before = docs.slice(1), docs.slice(0, len(docs) - 1)
        other = pc.or_(pc.not_equal(now, before).fill_null(False), pc.xor(now.is_null(), before.is_null()))
        new = np.flatnonzero(np.concatenate(([True], other.to_numpy(zero_copy_only=False))))
        place = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(docs))))
        w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))
        times = firsts[term + 1] - firsts[term]
        ends = np.cumsum(times)
        at = np.arange(ends[-1]) - np.repeat(ends - times - firsts[term], times)
        key, inverse = np.unique(np.repeat(place, times) * len(queries) + of[at], return_inverse=True)
        d, q = np.divmod(key, len(queries))
        return q, docs.take(pa.array(new[d])), np.round(np.bincount(inverse, np.repeat(w, times), len(key)), 6)

    def best(q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Places of the ``most`` best of each query, in the order of documents, which settles ties by id."""
        order = np.lexsort((-score, q))
        q = q[order]
        return np.sort(order[np.arange(len(q)) - np.searchsorted(q, q) < most])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= POSTINGS:
                table = pa.Table.from_batches(held).combine_chunks()
                same = pc.equal(table.column("doc_id"), table.column("doc_id")[n - 1]).fill_null(table.column("doc_id")[n - 1].as_py() is None)
                first = n - int(pc.sum(same).as_py())  # the last document goes on in the next batch
                if first:
                    yield table.slice(0, first)
                held = table.slice(first).to_batches()
                n -= first
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        out = lambda q, docs, score: pa.RecordBatch.from_arrays([queries.take(pa.array(q)), docs, pa.array(score)], ["query_id", "doc_id", "score"])
        for table in tiles(batches):
            now = scored(table)
            if most is None:
                yield out(*now)
                continue
            if top is not None:
                now = np.concatenate((top[0], now[0])), pa.concat_arrays([top[1], now[1]]), np.concatenate((top[2], now[2]))
            order = best(now[0], now[2])
            top = now[0][order], now[1].take(pa.array(order)), now[2][order]
        if top is not None:
            yield out(*top)

    return run


def _joined(docs: DataFrame, terms: DataFrame, prefix: bool) -> DataFrame:
    """BM25 by shuffled joins, for more terms than a task should hold."""
    tokens = docs.select("doc_id", T.words(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"))
    word = F.substring("t", 1, 8) if prefix else F.col("t")
    asked = terms.select("term").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    posts = tokens.select("doc_id", F.size("tokens").cast("double").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("t")).select("doc_id", "dl", word.alias("term"))
    held = cut(posts.join(asked, "term").groupBy("term", "doc_id", "dl").agg(F.count("*").cast("double").alias("tf")))
    stats = held.where("term = ''").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avg_dl"))
    tf = held.where("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    named = terms.join(df, "term").join(F.broadcast(stats))  # one row of totals
    return tf.repartition("doc_id").join(named, "term").select("query_id", "doc_id", weight.alias("w")).groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))


def bm25_fields(docs: DataFrame, terms: DataFrame, weights: dict[str, float]) -> DataFrame:
    """BM25 over several fields: a term's frequency is the weighted sum over fields, a row's length its tokens in all of them."""
    weighed_by = lambda w: lambda t: F.struct(t.alias("t"), F.lit(w).alias("w"))
    fields = [F.transform(T.words(F.coalesce(F.col(f), F.lit(""))), weighed_by(w)) for f, w in weights.items()]
    tokens = docs.select("doc_id", F.concat(*fields).alias("tokens"))
    stats = tokens.agg(F.count("*").cast("double").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_dl"))
    posts = tokens.select("doc_id", F.size("tokens").cast("double").alias("dl"), F.explode("tokens").alias("x")).select("doc_id", "dl", F.col("x.t").alias("term"), F.col("x.w").alias("w"))
    tf = posts.join(terms.select("term").distinct(), "term").groupBy("term", "doc_id", "dl").agg(F.sum("w").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    weighed = tf.join(df, "term").join(F.broadcast(stats)).select("term", "doc_id", weight.alias("s"))  # one row of totals
    return weighed.join(terms, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def ranked(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The k best items per query with their rank; ties go to the smaller item."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def at_least(hits: DataFrame, min_score: float) -> DataFrame:
    """Hits whose score reaches ``min_score``; ranks are those of the whole ranking, and a null score does not reach it."""
    return hits.where(F.col("score") >= min_score)


def scope(said: Column) -> Column:
    """A struct (kind, project) of a stated scope: ``all``, ``project:`` and a name, or else the current project."""
    named = F.startswith(said, F.lit("project:"))
    kind = F.when(said == "all", F.lit("all")).when(named, F.lit("project")).otherwise(F.lit("current"))
    return F.struct(kind.alias("kind"), F.when(named, F.substring(said, 9, 1 << 30)).alias("project"))


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in blocks of about half of QUERIES, dealt by a hash of their ids."""
    blocks = max(1, -(-2 * queries.count() // QUERIES))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) for k in range(blocks)]


def _stated(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a block of queries."""
    rows = queries.select("query_id", "embedding").collect()
    q = np.array([r.embedding for r in rows], dtype=float).reshape(len(rows), -1)
    return np.array([r.query_id for r in rows], dtype=np.int64), _unit(q)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=m.copy(), where=n > 0)


def _coarse(m: np.ndarray, dims: int) -> np.ndarray:
    """Leading components, scaled, quantised to 256 steps and back."""
    u = _unit(m[:, :dims])
    low = u.min(1, keepdims=True)
    scale = (u.max(1, keepdims=True) - low) / 255
    return np.where(scale > 0, np.round(np.divide(u - low, scale, out=np.zeros_like(u), where=scale > 0)), 0.0) * scale + low


def vector_scores(rows: DataFrame, queries: DataFrame, most: int, dims: int | None = None) -> DataFrame:
    """(query_id, vec_id, coarse, score): cosines of rows with a query batch, the ``most`` best of each Arrow batch.

    ``coarse`` orders the selection: it is the cosine over quantised leading ``dims`` components, or the score itself.
    Each task hands on at most ``most`` rows per query and batch, so the shuffle does not grow with the product.
    """
    return functools.reduce(DataFrame.unionByName, [_block_scores(rows, block, most, dims) for block in _blocks(queries)])


def _best(vec: np.ndarray, m: np.ndarray, q: np.ndarray, most: int, dims: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, coarse, score) of the ``most`` best rows of each query, tile by tile of queries; ties go to the smaller id."""
    u, c = _unit(m), _coarse(m, dims) if dims else None
    step = max(1, CELLS // len(vec))
    for first in range(0, len(q), step):
        asked = q[first : first + step]
        score = np.round(u @ asked.T, 6)
        coarse = np.round(c @ _unit(asked[:, :dims]).T, 6) if dims else score
        by = np.where(np.isnan(coarse), -np.inf, coarse)
        # all that reach the last place are sorted, so ties at it are settled by id
        k, at = np.nonzero((by >= np.partition(by, len(vec) - most, axis=0)[len(vec) - most]).T) if len(vec) > most else np.divmod(np.arange(by.size), len(vec))
        order = np.lexsort((vec[at], -by[at, k], k))
        k, at = k[order], at[order]
        kept = np.arange(len(k)) - np.searchsorted(k, k) < most
        k, at = k[kept], at[kept]
        yield first + k, at, coarse[at, k], score[at, k]


def _block_scores(rows: DataFrame, queries: DataFrame, most: int, dims: int | None) -> DataFrame:
    ids, q = _stated(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(0).to_numpy()
            if not len(vec) or not len(ids):
                continue
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vec), -1)
            for k, at, coarse, score in _best(vec, m, q, most, dims):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(vec[at]), pa.array(coarse), pa.array(score)], ["query_id", "vec_id", "coarse", "score"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, coarse double, score double")


def vector_top(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest by cosine."""
    return ranked(vector_scores(rows, queries, k).drop("coarse"), k, item="vec_id")


def two_stage(rows: DataFrame, queries: DataFrame, k: int, dims: int = 32) -> DataFrame:
    """Coarse scores on quantised leading components choose max(10 k, 100) candidates, exact cosines rank them."""
    most = max(10 * k, 100)
    w = Window.partitionBy("query_id").orderBy(F.desc("coarse"), "vec_id")
    chosen = vector_scores(rows, queries, most, dims).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return ranked(chosen.select("query_id", "vec_id", "score"), k, item="vec_id")


def rrf(rankings: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, doc_id, score, matched_by) of rankings (source, query_id, doc_id, rank): sum of w / (60 + rank)."""
    w = F.lit(1.0)
    for source, weight in weights.items():
        w = F.when(F.col("source") == source, F.lit(weight)).otherwise(w)
    return rankings.groupBy("query_id", "doc_id").agg(F.round(F.sum(w / (RRF_K + F.col("rank"))), 8).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("matched_by"))


def rerank_factor(query: Column, symbol: Column, kind: Column, tokens: Column, redacted: Column, tier: Column) -> Column:
    """Product of the rerank's declared factors."""
    q = F.lower(F.trim(query))
    named = (F.lower(symbol) == q) | F.lower(symbol).endswith(F.concat(F.lit("."), q))
    steps = (
        (F.coalesce(named, F.lit(False)), SYMBOL), (T.is_question(query) & (kind == "doc"), DOC_QUESTION), (T.is_identifier(query) & (kind == "code"), CODE_IDENTIFIER),
        (tokens < 32, SHORT), (redacted, REDACTED), (tier == "work", WORK_WEIGHT), (tier == "test", TEST_WEIGHT),
    )
    out = F.lit(1.0)
    for holds, factor in steps:
        out = out * F.when(holds, F.lit(factor)).otherwise(F.lit(1.0))
    return out


def diversify(hits: DataFrame, group: str, most: int = 3) -> DataFrame:
    """The first ``most`` hits per group keep their order, the others follow; none is dropped. Adds ``place``."""
    within = Window.partitionBy("query_id", group).orderBy("rank")
    over = (F.row_number().over(within) > most).cast("int")
    return hits.withColumn("__over", over).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("__over", "rank"))).drop("__over")
