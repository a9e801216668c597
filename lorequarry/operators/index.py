"""A kept inverted index: postings with positions, written once and read by every later search.

A folder holds, per segment, ``postings`` (a directory per bucket of terms; rows term, doc_id, field, tf, positions), ``terms``
(the segment's distinct terms) and ``lengths`` (doc_id, dl; a null dl is a deletion). Each batch of changes is a segment of
its own, so only its documents are tokenised; a document's newest segment is the one that counts. ``merge`` rewrites what is
live as one segment. What counts is named by the newest generation of ``manifest``, which is written last: a batch that dies
half-way leaves files that no generation names.

Terms follow the unicode tokenizer without diacritics. Queries become units: a word, a phrase, or either with a prefix as its
last word; a document's frequency of a unit is the weighted sum of its occurrences over the fields. All units are OR-ed.

Defined results: null texts are empty; a null doc_id takes no part; of rows of one batch that share an id one is kept, the
greatest by its fields; a query without words, or a malformed raw one, gives no rows; an empty index gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.functions.stats import rounded
from lorequarry.operators.search import B, FLOOR, K1, ranked
from lorequarry.operators.search import _summed as summed
from lorequarry.session import cut

BUCKETS = 64
#: Documents whose postings of a bucket make about one file, so that files, and the tasks that write them, are alike at every size.
FILE_DOCS = 1 << 15
#: Documents that are worth a task, and its files, of their own.
TASK_DOCS = 1 << 10
#: Tokens that a task groups at once.
RUN_TOKENS = 1 << 19
#: Fitting postings that a task of a search adds up at once.
MET = 1 << 20
#: Asked words that a search may give to every task; more of them are joined by a shuffle.
BROADCAST_TERMS = 100_000
_POSTING = "term string, doc_id long, field string, positions array<int>, tf int"
#: A raw query: words or quoted phrases, each with an optional prefix mark, between OR.
_ITEM = r'(?:"[^"]*"|[\p{L}\p{N}_]+)\*?'
RAW = rf"^\s*{_ITEM}(?:\s+OR\s+{_ITEM})*\s*$"


def tokens(text: Column) -> Column:
    """Words in lower case and without diacritics."""
    return F.regexp_extract_all(F.lower(T.folded(F.coalesce(text, F.lit("")))), F.lit(T.WORD), F.lit(0))


def _postings(fields: tuple[str, ...]):
    """(doc_id, tokens of each field) to postings (term, doc_id, field, positions, tf): what a document holds meets in its own row, without a shuffle. Each run comes in the order of terms."""

    def grouped(field: str, doc: np.ndarray, sizes: np.ndarray, words: pa.Array) -> pa.RecordBatch:
        coded = words.dictionary_encode()
        rows, inverse = max(len(doc), 1), pc.sort_indices(coded.dictionary).to_numpy()
        ranks = np.empty(len(inverse), np.int64)
        ranks[inverse] = np.arange(len(inverse))
        key = ranks[coded.indices.to_numpy(zero_copy_only=False)] * rows + np.repeat(np.arange(len(doc)), sizes)
        place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        tf = np.diff(np.append(first, len(key)))
        held = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[order], pa.int32()))
        columns = [coded.dictionary.take(pa.array(inverse[key[first] // rows])), pa.array(doc[key[first] % rows], pa.int64()), pa.array([field] * len(first), pa.string()), held, pa.array(tf, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "field", "positions", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for k, field in enumerate(fields):
                lists, start = batch.column(k + 1), 0
                ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
                while start < len(doc):  # runs of about RUN_TOKENS tokens, of one document at least
                    done = ends[start - 1] if start else 0
                    stop = max(start + 1, int(np.searchsorted(ends, done + RUN_TOKENS, side="right")))
                    part = lists.slice(start, stop - start)
                    yield grouped(field, doc[start:stop], np.diff(part.offsets.to_numpy()), part.flatten())
                    start = stop

    return run


def _lookup(each: pa.Table):
    """Of terms: places in them and the rows of ``each`` (token, open) that they fit, equal to the token or, where that is open, starting with it."""
    token, opened = each.column("token").combine_chunks(), each.column("open").to_numpy()
    length = pc.utf8_length(token).to_numpy()
    ways = []
    for size in (None, *np.unique(length[opened])):
        rows = np.flatnonzero(~opened if size is None else opened & (length == size))
        mine = token.take(pa.array(rows))
        asked = mine.unique()
        number = pc.index_in(mine, asked).to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        ways.append((size, asked, rows[order], np.searchsorted(number[order], np.arange(len(asked) + 1))))

    def find(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        places, fits = [], []
        for size, asked, rows, firsts in ways:
            at = pc.index_in(terms if size is None else pc.utf8_slice_codeunits(terms, 0, int(size)), asked).fill_null(-1).to_numpy(zero_copy_only=False)
            place = np.flatnonzero(at >= 0)
            times = firsts[at[place] + 1] - firsts[at[place]]
            ends = np.cumsum(times)
            places.append(np.repeat(place, times))
            fits.append(rows[np.arange(times.sum()) - np.repeat(ends - times - firsts[at[place]], times)])
        return np.concatenate(places), np.concatenate(fits)

    return find


def _fitting(find, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``find`` for terms in runs of equals, each looked up once."""
    coded = terms.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    firsts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    place, fit = find(coded.dictionary)
    times = firsts[place + 1] - firsts[place]
    ends = np.cumsum(times)
    return order[np.arange(times.sum()) - np.repeat(ends - times - firsts[place], times)], np.repeat(fit, times)


def _met(each: pa.Table):
    """(term, doc_id, segment, tf) to (doc_id, segment, unit, tf) of asked words, added up within about MET rows."""

    def added(parts: list[tuple]) -> pa.RecordBatch:
        key = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort(key[:3])
        unit, segment, doc, tf = (x[order] for x in key)
        first = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (segment[1:] != segment[:-1]) | (doc[1:] != doc[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(segment[first], pa.int32()), pa.array(unit[first], pa.int32()), pa.array(np.add.reduceat(tf, first))], ["doc_id", "segment", "unit", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, units_, parts, n = _lookup(each), each.column("unit").to_numpy(), [], 0
        for batch in batches:
            row, fit = _fitting(find, batch.column(0))
            if len(row):
                parts.append((units_[fit], *(batch.column(c).to_numpy()[row] for c in (2, 1, 3))))
                n += len(row)
            if n >= MET:
                yield added(parts)
                parts, n = [], 0
        if parts:
            yield added(parts)

    return run


def _met_places(each: pa.Table):
    """(term, doc_id, segment, field, positions) to (doc_id, segment, field, unit, of, at, s): where phrases would start for their words to stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _lookup(each)
        for batch in batches:
            row, fit = _fitting(find, batch.column(0))
            if len(row):
                asked, held = each.take(pa.array(fit)), batch.take(pa.array(row))
                s, at = held.column(4), asked.column("at").to_numpy()
                sizes = pc.list_value_length(s).to_numpy(zero_copy_only=False)
                starts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(s.flatten().to_numpy() - np.repeat(at, sizes), pa.int32()))
                yield pa.RecordBatch.from_arrays([held.column(1), held.column(2), held.column(3), *(asked.column(c).combine_chunks().cast(pa.int32()) for c in ("unit", "of", "at")), starts], ["doc_id", "segment", "field", "unit", "of", "at", "s"])

    return run


def _phrases(starts: DataFrame, w: Column, apart: bool) -> DataFrame:
    """(doc_id, segment, dl, unit, tf) of phrases: they stand where all of their places give the same start; a token has one place, so a start counts each place once."""
    whole = starts.groupBy("doc_id", "segment", "dl", "field", "unit", "of").agg(F.collect_set("at").alias("ats"), F.array_sort(F.flatten(F.collect_list("s"))).alias("s")).where("size(ats) = of")
    stands = F.filter("s", lambda x, i: F.try_element_at("s", i + F.col("of")) == x)
    after = lambda a, x: F.when(x >= a["end"], F.struct((a["n"] + 1).alias("n"), (x + F.col("of")).alias("end"))).otherwise(a)
    n = F.aggregate(stands, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), after)["n"] if apart else F.size(stands)
    return whole.withColumn("n", n).where("n > 0").groupBy("doc_id", "segment", "dl", "unit").agg(F.sum(w * F.col("n")).alias("tf"))


class Index:
    """The index in a folder that driver and executors share; ``fields`` are the columns of documents that it covers."""

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...] = ("text",), buckets: int = BUCKETS):
        self.spark, self.path, self.fields, self.buckets = spark, path.rstrip("/"), fields, buckets

    def _generations(self) -> DataFrame:
        return self.spark.read.schema("generation int, segments array<int>").parquet(f"{self.path}/manifest")

    def segments(self) -> tuple[int, list[int]]:
        """The newest generation and the segments that it names."""
        try:
            newest = self._generations().orderBy(F.desc("generation")).first()
        except Exception as e:  # noqa: BLE001  a folder without a manifest is an empty index
            if "PATH_NOT_FOUND" not in str(e):
                raise
            newest = None
        return (newest.generation, list(newest.segments)) if newest else (0, [])

    def _commit(self, generation: int, segments: list[int]) -> None:
        self.spark.createDataFrame([(generation, segments)], "generation int, segments array<int>").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, postings: DataFrame, segment: int, *order: str) -> DataFrame:
        """Postings as files of buckets, in the partitions that they come in; new ones come in runs sorted by term, so that only the number of the bucket is sorted."""
        rows, path = postings.withColumn("bucket", self._bucket(F.col("term"))), f"{self.path}/postings/segment={segment}"
        rows.sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(_POSTING).parquet(path)
        written.select("term").distinct().write.mode("overwrite").parquet(f"{self.path}/terms/segment={segment}")
        return written

    def _spread(self, rows: DataFrame) -> DataFrame:
        """Documents in tasks of FILE_DOCS at most, or less for four tasks a core, but of TASK_DOCS. They stay in the partitions that they are read in, unless few of those hold most."""
        total, most = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        cores = self.spark.sparkContext.defaultParallelism
        parts = max(1, min(4 * cores, -(-total // TASK_DOCS)), -(-total // FILE_DOCS))
        return rows.coalesce(parts) if most * min(cores, parts) <= 2 * total else rows.repartition(parts, "doc_id")

    def apply(self, docs: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """Inserts or replaces ``docs`` (doc_id and the fields) and deletes the ids of ``deleted``, as one segment; its number."""
        generation, segments = self.segments()
        segment = max(segments, default=0) + 1
        gone = deleted.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("dl")).where("doc_id IS NOT NULL").distinct() if deleted is not None else None
        if docs is None:
            docs = self.spark.createDataFrame([], "doc_id long, " + ", ".join(f"{f} string" for f in self.fields))
        whole = F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in self.fields])
        rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("d"))
        # only texts whose ids repeat move to meet each other
        again = cut(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
        n_again = again.count()
        if n_again:
            again = F.broadcast(again) if n_again <= BROADCAST_TERMS else again
            rows = rows.join(again, "doc_id", "left_anti").unionByName(rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("d").alias("d")))
        if gone is not None:
            rows = rows.join(gone.select("doc_id"), "doc_id", "left_anti")
        split = self._spread(rows).select("doc_id", *[tokens(F.col(f"d.{f}")).alias(f) for f in self.fields])
        written = self._write(split.mapInArrow(_postings(self.fields), _POSTING), segment)  # the one pass that tokenises
        size = written.select("doc_id", "tf").unionByName(rows.select("doc_id", F.lit(0).alias("tf"))).groupBy("doc_id").agg(F.sum("tf").alias("dl"))
        (size if gone is None else size.unionByName(gone)).write.mode("overwrite").parquet(f"{self.path}/lengths/segment={segment}")
        self._commit(generation + 1, [*segments, segment])
        return segment

    def _read(self, what: str, segments: list[int], schema: str) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, segment int" + (", bucket int" if what == "postings" else "")).parquet(f"{self.path}/{what}")
        return rows.where(F.col("segment").isin(segments))  # prunes directories

    def live(self, segments: list[int]) -> DataFrame:
        """(doc_id, segment, dl): the newest version of each document, deletions left out."""
        newest = self._read("lengths", segments, "doc_id long, dl long").groupBy("doc_id").agg(F.max_by(F.struct("segment", "dl"), "segment").alias("x"))
        return newest.select("doc_id", "x.segment", "x.dl").where("dl IS NOT NULL")

    def postings(self, segments: list[int], buckets: list[int] | None = None) -> DataFrame:
        rows = self._read("postings", segments, _POSTING)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def merge(self) -> int:
        """All live postings as one segment; nothing is tokenised. Files of older segments stay for readers of older generations."""
        generation, segments = self.segments()
        if len(segments) < 2:
            return segments[0] if segments else 0
        segment, live = max(segments) + 1, cut(self.live(segments))
        posts = self.postings(segments).join(live.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi").select("term", "doc_id", "field", "positions", "tf")
        # dealt by bucket and a share of the documents, so that a hot term is split among tasks
        shares = max(1, -(-live.count() // FILE_DOCS))
        self._write(posts.repartition(self._bucket(F.col("term")), F.pmod(F.xxhash64("doc_id"), F.lit(shares))), segment, "term", "doc_id")
        live.select("doc_id", "dl").write.mode("overwrite").parquet(f"{self.path}/lengths/segment={segment}")
        self._commit(generation + 1, [segment])
        return segment

    def search(self, queries: DataFrame, k: int = 10, raw: bool = False, weights: dict[str, float] | None = None, among: DataFrame | None = None, apart: bool = False) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best of each query; ``among`` limits hits, not statistics, to its doc_ids."""
        if among is None:
            return ranked(self.scores(queries, raw, weights, apart, k), k)
        return ranked(self.scores(queries, raw, weights, apart).join(among.select("doc_id").distinct(), "doc_id", "left_semi"), k)

    def scores(self, queries: DataFrame, raw: bool = False, weights: dict[str, float] | None = None, apart: bool = False, most: int | None = None) -> DataFrame:
        """(query_id, doc_id, score): BM25 of every document that has a unit of the query; ``apart`` counts phrases that share words once, from the left on.

        Tasks look the terms of postings up among the asked words and heads; what fits moves once, by document, and a task then
        adds up the scores of its documents. With ``most`` it hands on only so many of the best of each query, ties to the
        smaller id. Beyond BROADCAST_TERMS asked words both steps are shuffled joins, with the same scores.
        """
        _, segments = self.segments()
        asked = cut(units(queries, raw))
        if not segments or asked.isEmpty():
            return self.spark.createDataFrame([], "query_id long, doc_id long, score double")
        live = cut(self.live(segments))
        w = F.lit(1.0)
        for field, weight in (weights or {}).items():
            w = F.when(F.col("field") == field, F.lit(float(weight))).otherwise(w)
        kinds = asked.select("unit", "words", "prefix").distinct()
        each = kinds.select("unit", F.size("words").alias("of"), "prefix", F.posexplode("words").alias("at", "token")).withColumn("open", F.col("prefix") & (F.col("at") == F.col("of") - 1))
        if max(each.count(), asked.count()) > BROADCAST_TERMS:
            return self._joined(asked, each, live, segments, w, apart)
        buckets = [r.bucket for r in self._expanded(each, segments).select(self._bucket(F.col("term")).alias("bucket")).distinct().collect()]  # at most ``buckets``
        pairs, each = asked.select("query_id", "unit").toArrow().combine_chunks(), each.toArrow().combine_chunks()
        named, ids = each.column("unit").unique(), pairs.column("query_id").unique()
        each = each.set_column(0, "unit", pc.index_in(each.column("unit"), named))
        number = pc.index_in(pairs.column("unit"), named).to_numpy()
        order = np.argsort(number, kind="stable")
        of = pc.index_in(pairs.column("query_id"), ids, skip_nulls=False).to_numpy()[order]
        posts, held = self.postings(segments, buckets), live.hint("merge")  # a merge join keeps documents together for the sums that follow
        alone, places = each.filter(pc.equal(each.column("of"), 1)), each.filter(pc.greater(each.column("of"), 1))
        found = []
        if len(alone):
            met = posts.select("term", "doc_id", "segment", (w * F.col("tf")).alias("tf")).mapInArrow(_met(alone), "doc_id long, segment int, unit int, tf double")
            found.append(met.join(held, ["doc_id", "segment"]).groupBy("doc_id", "segment", "dl", "unit").agg(F.sum("tf").alias("tf")))
        if len(places):
            met = posts.select("term", "doc_id", "segment", "field", "positions").mapInArrow(_met_places(places), "doc_id long, segment int, field string, unit int, of int, at int, s array<int>")
            found.append(_phrases(met.join(held, ["doc_id", "segment"]), w, apart))
        # what a document scores lies in one task; a row a document is a fifth of a row a unit
        held = found[0] if len(found) == 1 else found[0].unionByName(found[1]).repartition("doc_id")
        held = cut(held.groupBy("doc_id", "segment", "dl").agg(F.collect_list("unit").alias("units"), F.collect_list("tf").alias("tfs")).sortWithinPartitions("doc_id"))
        n, avg = live.agg(F.count("*"), F.avg("dl")).first()
        df, counted = np.zeros(len(named)), held.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("df")).toArrow()  # a row per asked unit
        df[counted.column("unit").to_numpy()] = counted.column("df").to_numpy()
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), FLOOR)
        rows = held.select("doc_id", "dl", F.explode(F.arrays_zip("units", "tfs")).alias("x")).select("doc_id", "dl", F.col("x.units").alias("term"), F.col("x.tfs").alias("tf"))
        kind = asked.schema["query_id"].dataType.simpleString()
        return rows.mapInArrow(summed(idf, avg or 1.0, np.searchsorted(number[order], np.arange(len(named) + 1)), of, ids, most), f"query_id {kind}, doc_id long, score double")

    def _joined(self, asked: DataFrame, each: DataFrame, live: DataFrame, segments: list[int], w: Column, apart: bool) -> DataFrame:
        """Scores by shuffled joins, for more words than a task should hold."""
        stats = live.agg(F.count("*").cast("double").alias("n_docs"), F.avg("dl").alias("avg_dl"))
        met = self.postings(segments).join(self._expanded(each, segments), "term").join(live, ["doc_id", "segment"])
        single = met.where("of = 1").groupBy("doc_id", "segment", "dl", "unit").agg(F.sum(w * F.col("tf")).alias("tf"))
        starts = met.where("of > 1").select("doc_id", "segment", "dl", "field", "unit", "of", "at", F.transform("positions", lambda p: p - F.col("at")).alias("s"))
        # what a document scores meets in one place before queries spread it: many queries may share a unit
        found = cut(single.unionByName(_phrases(starts, w, apart)))
        df = found.groupBy("unit").agg(F.count("*").cast("double").alias("df"))
        idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
        named = asked.select("query_id", "unit").join(df, "unit").join(F.broadcast(stats))  # one row of totals
        return found.repartition("doc_id").join(named, "unit").select("query_id", "doc_id", weight.alias("s")).groupBy("query_id", "doc_id").agg(rounded(F.sum("s"), 6).alias("score"))

    def _expanded(self, each: DataFrame, segments: list[int]) -> DataFrame:
        """(unit, of, at, term): the word itself, or every term of the index that starts with it where the place is open."""
        closed = each.where(~F.col("open")).select("unit", "of", "at", F.col("token").alias("term"))
        sizes = [r[0] for r in each.where("open").select(F.length("token")).distinct().collect()]  # at most a number per word length
        if not sizes:
            return closed
        known = self._read("terms", segments, "term string").select("term").distinct()
        heads = known.select("term", F.explode(F.array(*[F.lit(n) for n in sorted(sizes)])).alias("n")).where(F.length("term") >= F.col("n"))
        heads = heads.select("term", F.expr("substring(term, 1, n)").alias("token"))
        return closed.unionByName(each.where("open").join(heads, "token").select("unit", "of", "at", "term"))


def units(queries: DataFrame, raw: bool = False) -> DataFrame:
    """(query_id, unit, words, prefix) of queries (query_id, text).

    Plain text: each word and the parts of a compound name are units, a word with several tokens is a phrase, and the last
    unit of two letters or more is a prefix. Raw text: words, quoted phrases and prefix marks between OR; what does not
    have that form has no units.
    """
    if raw:
        good = queries.where(F.col("text").rlike(RAW))
        items = good.select("query_id", F.explode(F.regexp_extract_all("text", F.lit(_ITEM), F.lit(0))).alias("item")).where("item <> 'OR'")
        found = items.select("query_id", tokens(F.col("item")).alias("words"), F.endswith("item", F.lit("*")).alias("prefix"))
    else:
        said = T.query_terms(F.coalesce(F.col("text"), F.lit("")))
        placed = queries.select("query_id", said.alias("said")).select("query_id", F.size("said").alias("of"), F.posexplode("said").alias("at", "item"))
        found = placed.select("query_id", tokens(F.col("item")).alias("words"), ((F.col("at") == F.col("of") - 1) & (F.length("item") > 1)).alias("prefix"))
    named = found.where(F.size("words") > 0).withColumn("unit", F.concat(F.array_join("words", " "), F.when(F.col("prefix"), "*").otherwise("")))
    return named.select("query_id", "unit", "words", "prefix").distinct()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for an index beside the session's checkpoints."""
    from uuid import uuid4

    from lorequarry.session import checkpoint_dir

    return f"{checkpoint_dir(spark)}/{re.sub('[^a-z_]', '', name)}-{uuid4().hex[:12]}"
