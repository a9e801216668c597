"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and perplexity against it.

The model is over characters within words, a language at a time: symbols are the characters of a word and its end, the
context reaches back to the word's start, orders are 1 to 5. Words of these languages are open-ended, so characters give
every word a probability without an unknown-word class, and the count tables level off as the corpus grows.

Training reads every trusted document. One narrow pass reduces texts to distinct n-grams with counts; everything after is
joins of count tables sharded by n-gram: continuation counts (grouped by suffix), context totals (grouped by prefix),
discounts per language and order from counts of counts, and probabilities joined order by order with the next lower one.
An n-gram that starts at a word's start keeps its raw count, as it has no left extension.

Scoring joins the shards of that model with the documents' n-grams. A shard holds whole context families (all n-grams
whose context ends in the same two characters), so every symbol is scored by exactly one shard and sums add up. A shard
has at most ``SHARD_ROWS`` entries of 12 bytes, which bounds what is broadcast; a larger model means more shards, and every
``TOGETHER`` shards a pass of their own. Words repeat, so a task scores each distinct word once.

Texts are dealt into two folds by their hash. A text is scored by the model of the trusted texts of the other fold, never by
one that has seen it or an exact copy, so that perplexities of trusted and of unseen clean documents compare. A document is
rejected when its perplexity is above the quantile ``QUANTILE`` of the trusted documents of its language, and a margin.

Defined results: a text without words and a language without trusted text have a null perplexity and are kept; a null
language is the empty one; characters beyond 4095 share 2048 codes; several labels of one document count as trusted if
any is; repeated rows are scored one by one; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.llm.common import BROADCAST_ROWS, texts, without
from lorequarry.session import cut

ORDER, BITS = 5, 12
SHARD_ROWS, TOGETHER = 1 << 20, 4
QUANTILE, MARGIN = 0.995, 0.2  # the margin is in nats a symbol
FOLDS = 2
#: Distinct words that a task holds scores or counts of before it starts afresh, and bytes of text that it splits at once.
WORDS, RUN = 1 << 17, 1 << 21
#: Size of the alphabet that the lowest order falls back on evenly.
ALPHABET = 1 << BITS
_MASK = (1 << BITS) - 1
_LENGTH = 60  # an n-gram's code: 12 bits a symbol, the last lowest, and its length above them


def _symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words, each led and followed by the boundary 0, and the place of each symbol in its word (0: the lead)."""
    joined = ("\0" + "\0".join(w.decode().replace("\0", " ") for w in words) + "\0").encode("utf-32-le")
    codes = np.frombuffer(joined, dtype="<u4").astype(np.uint64)
    codes = np.where(codes > 4095, 2048 + (codes & np.uint64(2047)), codes)
    at = np.arange(len(codes))
    starts = np.maximum.accumulate(np.where(codes == 0, at, 0))
    lead = np.concatenate(([0], starts[:-1]))  # the boundary before each symbol; an end boundary is also the next lead
    return codes, at - lead


def _grams(codes: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of at most ``order`` symbols that end at each symbol but the first, and their lengths."""
    n = np.minimum(place + 1, order)[1:]
    out = np.zeros(len(n), dtype=np.uint64)
    for k in range(order):
        held = np.zeros(len(n), dtype=np.uint64)
        held[max(0, k - 1) :] = codes[1 + max(0, k - 1) - k : len(codes) - k]
        out |= np.where(n > k, held << np.uint64(BITS * k), np.uint64(0))
    return out, n


def _code(gram: np.ndarray, n) -> np.ndarray:
    return gram | (np.asarray(n).astype(np.uint64) << np.uint64(_LENGTH))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n, c): the longest n-grams, counted over runs of about WORDS distinct words."""
    seen: dict[str, Counter] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, held in texts(batch.column(1), RUN):
            for k, text in enumerate(held):
                seen.setdefault(langs[first + k], Counter()).update(text.split())
            if sum(map(len, seen.values())) >= WORDS:
                yield from _counted(seen)
                seen = {}
    yield from _counted(seen)


def _counted(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, counter in seen.items():
        if not counter:
            continue
        codes, place = _symbols(list(counter))
        gram, n = _grams(codes, place, ORDER)
        weight = np.repeat(np.fromiter(counter.values(), dtype=np.int64), np.diff(np.flatnonzero(codes == 0)))
        unique, inverse = np.unique(_code(gram, n), return_inverse=True)
        c = np.bincount(inverse, weights=weight).astype(np.int64)
        length = (unique >> np.uint64(_LENGTH)).astype(np.int32)
        bare = (unique & np.uint64((1 << _LENGTH) - 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(bare), pa.array(length), pa.array(c)], ["lang", "gram", "n", "c"])


def _discounted(table: DataFrame) -> DataFrame:
    """Adds ``own = max(c - D, 0) / total`` and ``keep``, the weight that the context leaves to the lower order."""
    n1, n2, n3, n4 = (F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4))
    y = n1 / F.greatest(n1 + 2 * n2, F.lit(1))
    step = lambda k, a, b: F.greatest(F.lit(0.0), F.least(F.lit(float(k)), k - (k + 1) * y * b / F.greatest(a, F.lit(1))))
    discounts = table.groupBy("lang").agg(step(1, n1, n2).alias("d1"), step(2, n2, n3).alias("d2"), step(3, n3, n4).alias("d3"))  # a row per language
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    known = table.join(F.broadcast(discounts), "lang").select("lang", "gram", "ctx", "c", d.alias("d"))
    totals = known.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
    # an even share of at least a millionth is always left, so that no symbol has probability zero
    keep = F.greatest(F.col("left") / F.col("total"), F.lit(1e-6))
    return known.join(totals, ["lang", "ctx"]).select("lang", "gram", "ctx", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), keep.alias("keep"))


def train(trusted: DataFrame) -> DataFrame:
    """The model of rows (lang, text): (lang, code, value, family), materialised.

    An n-gram's value is its log probability, a context's (marked by a negative code) the log weight that it leaves to the
    lower order. ``family`` is the context's last two symbols, or null where all shards need the row.
    """
    counted = cut(trusted.mapInArrow(_count, "lang string, gram long, n int, c long").groupBy("lang", "gram", "n").agg(F.sum("c").alias("c")))
    levels, higher = {}, None
    for n in range(ORDER, 0, -1):
        rows = counted.where(F.col("n") == n).select("lang", "gram", "c")
        if higher is not None:
            wide = (1 << BITS * n) - 1
            tails = higher.select("lang", F.col("gram").bitwiseAND(F.lit(wide)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
            rows = rows.unionByName(tails)
        higher = levels[n] = cut(rows.select("lang", "gram", F.shiftright("gram", BITS).alias("ctx"), "c"))
    lower, model = None, None
    for n in range(1, ORDER + 1):
        t = _discounted(levels[n])
        if lower is None:
            p = t.withColumn("p", F.col("own") + F.col("keep") / ALPHABET)
        else:
            wide = (1 << BITS * (n - 1)) - 1
            t = t.withColumn("tail", F.col("gram").bitwiseAND(F.lit(wide)))
            p = t.join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("below")), ["lang", "tail"]).withColumn("p", F.col("own") + F.col("keep") * F.col("below"))
        p = cut(p.select("lang", "gram", "ctx", "keep", "p"))
        lower = p
        family = F.when(F.lit(n >= 3), F.col("ctx").bitwiseAND(F.lit((1 << 2 * BITS) - 1)))
        grams = p.select("lang", F.col("gram").bitwiseOR(F.lit(n << _LENGTH)).alias("code"), F.log("p").alias("value"), family.alias("family"))
        marks = p.select("lang", F.when(F.lit(n > 1), -1 - F.col("ctx").bitwiseOR(F.lit((n - 1) << _LENGTH))).otherwise(F.lit(-1)).alias("code"), F.log("keep").alias("value"), family.alias("family")).distinct()
        rows = grams.unionByName(marks)
        model = rows if model is None else model.unionByName(rows)
    return cut(model)


class Shard:
    """Entries of some context families, per language, sorted for binary search. ``number`` of ``of``."""

    def __init__(self, number: int, of: int, tables: dict):
        self.number, self.of, self.tables = number, of, tables

    @staticmethod
    def _find(table, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return keys[at] == codes, values[at]

    def score(self, lang, words: list[bytes]) -> np.ndarray:
        """Log probability of each word, over the symbols whose family this shard has."""
        table = self.tables.get(lang)
        if table is None:
            return np.zeros(len(words))
        codes, place = _symbols(words)
        gram, n = _grams(codes, place, ORDER)
        owner = np.repeat(np.arange(len(words)), np.diff(np.flatnonzero(codes == 0)))
        if self.of > 1:
            ctx = np.where(n >= 3, (gram >> np.uint64(BITS)) & np.uint64((1 << 2 * BITS) - 1), np.uint64(0))
            mine = shard_of(ctx.astype(np.int64), self.of) == self.number
            gram, n, owner = gram[mine], n[mine], owner[mine]
        total = np.zeros(len(gram))
        open_ = np.arange(len(gram))
        for k in range(ORDER, 0, -1):
            now = open_[n[open_] >= k]
            g = gram[now] & np.uint64((1 << BITS * k) - 1)
            hit, value = self._find(table, _code(g, np.full(len(g), k)).astype(np.int64))
            total[now[hit]] += value[hit]
            miss = now[~hit]
            ctx = (g[~hit] >> np.uint64(BITS)).astype(np.int64)
            mark, left = self._find(table, -1 - (ctx | ((k - 1) << _LENGTH)))
            total[miss[mark]] += left[mark]
            keep = np.ones(len(open_), dtype=bool)
            keep[np.flatnonzero(n[open_] >= k)[hit]] = False
            open_ = open_[keep]
        total[open_] -= math.log(ALPHABET)
        return np.bincount(owner, weights=total, minlength=len(words))


def shard_of(family: np.ndarray, of: int) -> np.ndarray:
    return (family ^ (family >> 7)) % 1_000_003 % of


def shards(model: DataFrame) -> list:
    """The model as broadcast shards of at most SHARD_ROWS entries each (unless one family alone has more)."""
    spark = model.sparkSession
    total = model.count()
    of = max(1, math.ceil(total * 1.25 / SHARD_ROWS))
    f = F.coalesce("family", F.lit(0))
    number = f.bitwiseXOR(F.shiftright(f, 7)) % 1_000_003 % of
    out = []
    for k in range(of):
        rows = model.where(F.col("family").isNull() | (number == k)).select("lang", "code", F.col("value").cast("float")).toArrow()
        langs = np.array(rows.column("lang").to_pylist(), dtype=object)
        code, value = rows.column("code").to_numpy(), rows.column("value").to_numpy()
        tables = {}
        for lang in set(langs):
            own = np.flatnonzero(langs == lang)
            order = own[np.argsort(code[own])]
            tables[lang] = (code[order], value[order])
        out.append(spark.sparkContext.broadcast(Shard(k, of, tables)))
    return out


def _scores(held: list):
    """For mapInArrow over (id, hash, lang, text): adds symbol counts and log probabilities under the held shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.value for b in held]
        known: dict = {}
        for batch in batches:
            langs = batch.column(2).to_pylist()
            for first, run_of in texts(batch.column(3), RUN):
                split = [t.split() for t in run_of]
                fresh: dict = {}
                for k, words in enumerate(split):
                    lang = langs[first + k]
                    fresh.setdefault(lang, set()).update(words)
                if sum(map(len, known.values())) > WORDS:
                    known = {}
                for lang, words in fresh.items():
                    scores = known.setdefault(lang, {})
                    new = list(words - scores.keys())
                    if new:
                        scores.update(zip(new, sum(p.score(lang, new) for p in parts).tolist(), strict=True))
                logp, n = [], []
                for k, words in enumerate(split):
                    logp.append(sum(map(known[langs[first + k]].__getitem__, words)))
                    n.append(len(run_of[k].decode()) - _spaces(run_of[k]) + len(words))
                columns = [batch.column(c).slice(first, len(split)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(logp, pa.float64())], ["id", "hash", "lang", "n", "logp"])

    return run


def _spaces(text: bytes) -> int:
    return len(text) - len(text.translate(None, b" \t\n\r\x0b\x0c"))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, hash of its text, lang, n symbols, logp, perplexity, trusted; materialised."""
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fold = F.pmod(F.xxhash64(text), F.lit(FOLDS))
    key = lambda k: F.concat_ws("\0", F.coalesce(F.col(lang_col).cast("string"), F.lit("")), k.cast("string"))  # noqa: E731  a language and a fold
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), key((fold + 1) % FOLDS).alias("lang"), key(fold).alias("own"), text.alias("text"))
    good = labels.where("quality = 1 AND toxic = 0").select(F.col("doc_id").cast("long").alias("id")).distinct()
    few = good.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = shards(train(rows.select("id", F.col("own").alias("lang"), "text").join(F.broadcast(good) if few else good, "id", "left_semi").select("lang", "text")))
    rows, schema = rows.drop("own"), "id long, hash long, lang string, n long, logp double"
    out = cut(rows.mapInArrow(_scores(held[:TOGETHER]), schema))
    for k in range(TOGETHER, len(held), TOGETHER):
        # equal texts of one language have equal parts, so one of them serves all
        more = rows.mapInArrow(_scores(held[k : k + TOGETHER]), schema).select(F.col("hash").alias("h"), F.col("lang").alias("l"), F.col("logp").alias("part")).dropDuplicates(["h", "l"])
        out = cut(out.join(more, (F.col("hash") == F.col("h")) & (F.col("lang") == F.col("l"))).select("id", "hash", "lang", "n", (F.col("logp") + F.col("part")).alias("logp")))
    known = F.col("lang").isin(list(held[0].value.tables))
    perplexity = F.when(known & (F.col("n") > 0), F.exp(-F.col("logp") / F.col("n")))
    return cut(out.withColumn("perplexity", perplexity).withColumn("lang", F.substring_index("lang", "\0", 1)).join(good.withColumn("trusted", F.lit(True)), "id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold): the quantile of trusted perplexities, to a thousandth of a nat, over all trusted rows."""
    bucket = F.ceil(F.log("perplexity") * 1000)
    counts = scored.where("trusted AND perplexity IS NOT NULL").groupBy("lang", bucket.alias("b")).count()
    w = Window.partitionBy("lang")
    share = F.sum("count").over(w.orderBy("b")) / F.sum("count").over(w)
    return counts.withColumn("share", share).where(F.col("share") >= quantile).groupBy("lang").agg(F.exp(F.min("b") / 1000 + MARGIN).alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, **columns) -> DataFrame:
    """Per row: id, hash, lang, n, perplexity, threshold, keep."""
    scored = scores(docs, labels, **columns)
    limit = thresholds(scored, quantile).withColumnRenamed("lang", "of")
    met = scored.join(F.broadcast(limit), F.col("lang") == F.col("of"), "left")  # a row per language
    return met.select("id", "hash", "lang", "n", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, symbols, perplexity, threshold, keep."""
    return judge(docs, labels).select(F.col("id").alias("doc_id"), "lang", F.col("n").alias("symbols"), F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "keep")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns unchanged."""
    gone = cut(judge(docs, labels, id_col=id_col, text_col=text_col).where(~F.col("keep")).select("id", "hash").distinct())
    return without(docs, gone, {"id": F.col(id_col).cast("long"), "hash": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
