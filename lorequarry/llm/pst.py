"""Language-model scores from a probabilistic suffix tree over tokens.

Tokens are words and one end per text. The root knows the whole vocabulary: P(w) = (c + 0.5) / (N + 0.5 (V + 1)). Contexts
are one to three earlier tokens, or the text's start and those after it. A context that at least LEAST training tokens follow
is a candidate state at any size of the corpus, and so are its next tokens seen as often there (``SHARE`` may ask for more; it
is 0). With c(s) occurrences, a state s gives a kept next token (c(s w) - D) / c(s), plus what is left over, L(s), times its
probability under the longest retained suffix of s; other tokens get L(s) times that alone, so that every distribution sums to
one. A state is retained when the log-likelihood that it gains over that suffix, its divergence times c(s), exceeds ln(N) / 2
for each kept token. A text is scored token by token in the longest retained suffix of what came before.

Counting covers every training text at every size. Words are counted by one aggregation. N-grams follow in two rounds: the
first sums occurrences in hashed buckets, which are never less than those of an n-gram in them, into a bitmap of buckets that
reach the limit; the second counts exactly what the bitmap lets through, and a count below the limit is then dropped. N-grams
of words that have numbers travel as these, in order, which takes a third of their codes' bytes; the others travel as codes.

Scoring is a sum over n-grams. With G(s) the sum of log L over the retained suffixes of s, a token's log probability is that of
the root, plus G of what came before, plus E(s w) = log P(w | s) - G(s) - log P(w) for the longest s w that is kept in a
retained state s. So a state is worth log L(s) wherever it occurs, and s w is worth E(s w) less E of its longest such suffix:
a text's score is its base score plus what its n-grams are worth. The HOT n-grams and words that occur most are broadcast; the
others, which grow with the corpus, stay in tables that are joined with the texts' other words and n-grams: words row by row,
n-grams in blocks of a run's sorted codes and owners, dealt by the codes' first bits, which give one sum a text and part back.

Defined results: a null text is empty and has its end alone; a null id counts as the empty string in the choice of training
texts; repeated rows are scored one by one; without training texts V and N are 0 and every score is that of the root; an
empty table gives no rows; other columns are not read. Codes of n-grams are 64-bit polynomials of the words' XXH64.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.llm.common import texts
from lorequarry.session import cut

#: Longest context; share of all training tokens and number of times that an n-gram must have; the discount of a kept one.
DEPTH, SHARE, LEAST, DISCOUNT = 3, 0.0, 4, 0.5
#: Distinct words that a task counts before it hands them on, tokens of a span, and bytes of text that are split at once.
WORDS, SPAN, RUN = 1 << 17, 1 << 21, 1 << 21
#: Words and n-grams that are broadcast; the others are joined.
HOT_WORDS, HOT = 1 << 18, 1 << 21
#: Most bits of either half of the map of n-grams worth counting and of that of n-grams to ask for (two bits each), 64 MB each; bits that are put together at once.
BITS, CHUNK = 29, 20
#: Training tokens for each part that n-grams are counted in, and for each part that those of texts are looked up in.
PART, ASKED = 1 << 19, 1 << 24
RARE, START, END = 0, 1, 2
_B, _MIX, _MIX2 = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (word, c) over runs of about WORDS distinct words; the end is the empty word."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = pa.array(list(seen), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        for _, held in texts(batch.column(0), RUN):
            for text in held:
                seen.update(text.lower().split())
            seen[b""] += len(held)
            if len(seen) >= WORDS:
                yield out()
                seen = Counter()
    if seen:
        yield out()


def encode(held: list[bytes], numbers: dict[bytes, int]) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers of texts, each between START and END, and the tokens themselves."""
    flat: list[bytes] = []
    for text in held:
        flat.append(b" ")
        flat += text.lower().split()
        flat.append(b"")
    return np.fromiter(map(numbers.get, flat, repeat(RARE)), dtype=np.int32, count=len(flat)), flat


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), dtype=np.uint64, count=len(words))


def hashed(ids: np.ndarray, flat: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """XXH64 of each token: of those with a number from a table, of rare ones from the word."""
    out, rare = hashes[ids], np.flatnonzero(ids == RARE)
    if len(rare):
        out[rare] = _hash([flat[i] for i in rare.tolist()])
    return out


def longer(codes: np.ndarray) -> np.ndarray:
    """Codes of the n-grams that end at each place, from those of the (n - 1)-grams in them; a 1-gram's code is its token's hash."""
    out = np.zeros(len(codes), dtype=np.uint64)
    np.multiply(codes[:-1], np.uint64(_B), out=out[1:])
    out += codes
    return out


def ages(begins: np.ndarray) -> np.ndarray:
    """How many tokens up to each place are in one text, the start counted; DEPTH + 1 stands for more."""
    at = np.arange(len(begins))
    return np.minimum(at - np.maximum.accumulate(np.where(begins, at, 0)) + 1, DEPTH + 1).astype(np.int8)


def _bucket(codes: np.ndarray, bits: int, mix: np.uint64 = _MIX) -> np.ndarray:
    return (codes ^ (codes >> np.uint64(29))) * mix >> np.uint64(64 - bits)


def _half(n: int, codes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of n-grams: pairs in one half of the map, longer ones in the other."""
    return _bucket(codes, bits) + np.uint64((n > 2) << bits)


def _in(marks: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (marks[buckets >> np.uint64(6)] >> (buckets & np.uint64(63)) & np.uint64(1)).astype(bool)


def _spans(batches: Iterator[pa.RecordBatch], state) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and numbers of the tokens of texts."""
    numbers, hashes = state.value
    held, given, n = [], [], 0
    for batch in batches:
        for _, run in texts(batch.column(0), RUN):
            ids, flat = encode(run, numbers)
            held.append(hashed(ids, flat, hashes))
            given.append(ids)
            n += len(ids)
            if n >= SPAN:
                yield np.concatenate(held), np.concatenate(given)
                held, given, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(given)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of integers, first of all the lowest ones, which compresses better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _values(raw: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _met(met: np.ndarray) -> pa.RecordBatch:
    """(chunk, n, packed) of buckets, which may repeat: how often each is met (255 stands for more)."""
    met.sort()
    first = np.flatnonzero(np.diff(met, prepend=~met[:1]))
    buckets, c = met[first], np.minimum(np.diff(first, append=len(met)), 255).astype(np.uint8)
    chunks, begin = np.unique(buckets >> np.uint32(CHUNK), return_index=True)
    out, ends = [], np.append(begin[1:], len(buckets))
    for i, j in zip(begin, ends, strict=True):
        low = np.diff(buckets[i:j] & np.uint32((1 << CHUNK) - 1), prepend=np.uint32(0))
        out.append(pa.compress(_planes(low) + c[i:j].tobytes(), "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(chunks.astype(np.int32)), pa.array((ends - begin).astype(np.int32)), pa.array(out, pa.binary())], ["chunk", "n", "packed"])


def _sketch(state, bits: int):
    """(text) to (chunk, n, packed): per span and chunk of the map, the buckets met and how often (255 stands for more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, ids in _spans(batches, state):
            age, codes, met = ages(ids == START), tokens, []
            for n in range(2, DEPTH + 2):
                codes = longer(codes)
                met.append(_half(n, codes[age >= n], bits).astype(np.uint32))
                if n == 2 or n == DEPTH + 1:
                    yield _met(np.concatenate(met))
                    met.clear()

    return run


def _reach(least: int):
    """(chunk, n, packed) of one chunk to (chunk, bits): its buckets that are met ``least`` times in all."""

    def run(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << CHUNK, dtype=np.int64)
        for n, packed in zip(group.column("n").to_pylist(), group.column("packed"), strict=True):
            raw = np.frombuffer(pa.decompress(packed.as_buffer(), 5 * n, "zstd"), dtype=np.uint8)
            low = np.cumsum(_values(raw[: 4 * n], np.uint32))
            c = raw[4 * n :].astype(np.int64)
            total[low] += np.where(c == 255, least, c)
        bits = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    return run


def _blocks(part: np.ndarray, pack) -> list[tuple[int, int, bytes]]:
    """(part, n, packed) of each run of equal parts; ``pack`` gives the bytes of rows from one place to another."""
    held, begin = np.unique(part, return_index=True)
    ends = np.append(begin, len(part))[1:]
    return [(k, j - i, pa.compress(pack(slice(i, j)), "zstd", asbytes=True)) for k, i, j in zip(held.tolist(), begin.tolist(), ends.tolist(), strict=True)]


def _raw(packed: pa.BinaryScalar, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed.as_buffer(), size, "zstd"), dtype=np.uint8)


def _count(state, bitmap, bits: int, parts: int):
    """(text) to (part, numbered, n, packed): marked n-grams of a span and their counts.

    Those of numbered words are packed as four numbers (0 after the last word), the others as length and codes of what
    precedes the last token and follows the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bitmap.value
        for tokens, ids in _spans(batches, state):
            age, codes, good, rows = ages(ids == START), tokens, None, []
            for n in range(2, DEPTH + 2):
                before, codes = codes, longer(codes)
                mine = age >= n
                if good is not None:  # no n-gram occurs more often than those within it
                    mine[1:] &= good[1:] & good[:-1]
                at = np.flatnonzero(mine)
                at = at[_in(marks, _half(n, codes[at], bits))]
                if not len(at):
                    break
                good = np.zeros(len(tokens), dtype=bool)
                good[at] = True
                unique, first, c = np.unique(codes[at], return_index=True, return_counts=True)
                last = at[first]
                words = [ids[last - n + 1 + k] if k < n else np.zeros(len(c), np.int32) for k in range(DEPTH + 1)]
                rows.append((unique, before[last - 1], before[last], np.full(len(c), n, np.uint8), c.astype(np.uint32), *words))
            if not rows:
                continue
            code, ctx, suf, length, c, *words = map(np.concatenate, zip(*rows, strict=True))
            rows.clear()  # else two copies stay while blocks are packed
            part = (_bucket(code, 32) % np.uint64(parts)).astype(np.int64)
            numbered = sum((w != RARE).astype(np.uint8) for w in words) == length
            at = np.flatnonzero(numbered)
            at = at[np.argsort((part[at] << 48) + (words[0][at].astype(np.int64) << 24) + words[1][at])]
            own, times = [w[at] for w in words], c[at]
            out = [(k, True, n, x) for k, n, x in _blocks(part[at], lambda i: b"".join(map(_planes, (np.diff(own[0][i], prepend=np.int32(0)), *(w[i] for w in own[1:]), times[i]))))]  # noqa: B023
            at = np.flatnonzero(~numbered)
            at = at[np.lexsort((ctx[at], part[at]))]
            ctx, suf, length, times = ctx[at], suf[at], length[at], c[at]
            out += [(k, False, n, x) for k, n, x in _blocks(part[at], lambda i: _planes(np.diff(ctx[i], prepend=np.uint64(0))) + _planes(times[i]) + length[i].tobytes() + suf[i].tobytes())]  # noqa: B023
            kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "numbered", "n", "packed"])

    return run


def _total(state, least: int):
    """(part, numbered, n, packed) of one part to (n, code, ctx, suf, c) of its n-grams that occur ``least`` times in all."""

    def run(group: pa.Table) -> pa.Table:
        rows = []
        for numbered, n, packed in zip(group.column("numbered").to_pylist(), group.column("n").to_pylist(), group.column("packed"), strict=True):
            if not numbered:
                raw = _raw(packed, 21 * n)
                rows.append((np.cumsum(_values(raw[: 8 * n], np.uint64), dtype=np.uint64), _values(raw[8 * n : 12 * n], np.uint32), raw[12 * n : 13 * n], np.frombuffer(raw[13 * n :].tobytes(), np.uint64)))
                continue
            first, *words, c = (_values(x, np.uint32) for x in _raw(packed, 4 * n * (DEPTH + 2)).reshape(DEPTH + 2, -1))
            words = [np.cumsum(first, dtype=np.uint32), *words]
            length = sum((w != RARE).astype(np.uint8) for w in words)
            ctx, suf = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            within = [state.value[1][w] for w in words]
            for k in range(2, DEPTH + 2):  # codes of the (k - 1)-grams that begin at each word
                at = length == k
                ctx[at], suf[at] = within[0][at], within[1][at]
                within = [x * np.uint64(_B) + y for x, y in zip(within, within[1:], strict=False)]
            rows.append((ctx, c, length, suf))
        ctx, c, length, suf = map(np.concatenate, zip(*rows, strict=True))
        code = ctx * np.uint64(_B) + suf
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        total = np.add.reduceat(c[order].astype(np.int64), first)
        some = total >= least
        at = order[first[some]]
        columns = [pa.array(length[at].astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (code[first[some]], ctx[at], suf[at])), pa.array(total[some])]
        return pa.Table.from_arrays(columns, ["n", "code", "ctx", "suf", "c"])

    return run


class Model:
    """What a task scores with: hot words' numbers, hashes, counts and root log10 probabilities, what hot n-grams are worth, and maps of these and of those to ask for."""

    def __init__(self, numbers: dict[bytes, int], hashes: np.ndarray, counts: np.ndarray, root: np.ndarray, worth: tuple[np.ndarray, np.ndarray, np.ndarray], others: np.ndarray, n_states: int):
        self.numbers, self.hashes, self.counts, self.root = numbers, hashes, counts, root
        self.codes, self.last, self.ctx = worth
        self.bits = _power(16 * len(self.codes), 6, 24)
        self.marks, self.others, self.n_states = np.zeros(1 << (self.bits - 6), dtype=np.uint64), others, n_states
        b = _bucket(self.codes, self.bits)
        np.bitwise_or.at(self.marks, b >> np.uint64(6), np.uint64(1) << (b & np.uint64(63)))
        self.row_of, self.asks = np.full(len(hashes), -1, dtype=np.int32), np.zeros(len(hashes), dtype=bool)
        hot, row, asked = self.find(hashes)
        self.row_of[hot], self.asks[asked] = row, True
        self.row_of[RARE], self.asks[RARE] = -1, False

    def slim(self) -> "Model":
        """The same with one sum for each hot n-gram, which is what a whole text's score needs."""
        out = copy.copy(self)
        out.last, out.ctx = self.last + self.ctx, self.ctx[:0]
        return out

    def find(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which codes are hot, their rows in the hot table, and which others may be worth something."""
        hot = np.flatnonzero(_in(self.marks, _bucket(own, self.bits)))
        row = np.searchsorted(self.codes, own[hot])
        if len(self.codes):
            met = self.codes[np.minimum(row, len(self.codes) - 1)] == own[hot]
            hot, row = hot[met], row[met]
        asked = np.zeros(0, dtype=np.int64)
        if len(self.others):
            wide = (len(self.others) * 64).bit_length() - 1
            some = _in(self.others, _bucket(own, wide))
            some[hot] = False
            asked = np.flatnonzero(some)
            asked = asked[_in(self.others, _bucket(own[asked], wide, _MIX2))]
        return hot, row, asked

    def places(self, ids: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, rows of the hot table) of hot n-grams of each length, and (places, codes) of others that may be worth something."""
        row = self.row_of[ids]
        hot = np.flatnonzero(row >= 0)
        asked = np.flatnonzero(self.asks[ids]) if len(self.others) else np.zeros(0, dtype=np.int64)
        yield hot, row[hot], asked, tokens[asked]
        age, codes = ages(ids == START), tokens
        for n in range(1, DEPTH + 2):
            codes = codes if n == 1 else longer(codes)
            at = np.flatnonzero(ids == RARE if n == 1 else age >= n)  # words with numbers are done
            own = codes[at]
            hot, row, asked = self.find(own)
            yield at[hot], row, at[asked], own[asked]

    def score(self, ids: np.ndarray) -> np.ndarray:
        """log10 probability of each token from hot n-grams; of rare ones only what states leave to the root."""
        out = np.where(ids == RARE, 0.0, self.root[ids])
        for at, row, _, _ in self.places(ids, self.hashes[ids]):
            out[at] += self.last[row]
            here = at + 1 < len(ids)
            out[at[here] + 1] += self.ctx[row[here]]
        return out


def _rows(state, bits: int):
    """(id, held, text) and a model's ``slim`` form to one row a text: counts, sums over what is hot, its rare words; then, for each run and part, texts' n-grams that may be worth something.

    Those are codes with the texts that they are in, counted from ``row``; the part is a code's first bits.
    """
    names = ["row", "id", "held", "n", "known", "base", "hot", "rare", "times", "part", "packed"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def rows(many: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(many, kind)) for name, kind in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = state.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, run_of in texts(batch.column(2), RUN):
                ids, flat = encode(run_of, model.numbers)
                starts = np.flatnonzero(ids == START)
                size = np.diff(np.append(starts, len(ids))) - 1
                owner = np.repeat(np.arange(len(starts)), size + 1)
                rare, own = ids == RARE, ids != START
                total = lambda x: np.bincount(owner, weights=np.where(own, x, 0.0), minlength=len(starts))  # noqa: E731, B023
                base = total(np.where(rare, 0.0, model.root[ids]))
                known = total(model.counts[ids] > 0).astype(np.int64)
                more, asked, whose = np.zeros(len(starts)), [], []
                for at, hot, other, codes in model.places(ids, hashed(ids, flat, model.hashes)):
                    more += np.bincount(owner[at], weights=model.last[hot], minlength=len(starts))
                    asked.append(codes)
                    whose.append(owner[other].astype(np.int32))
                places = np.flatnonzero(rare)
                cuts = np.searchsorted(owner[places], np.arange(len(starts) + 1))
                words, times = [], []
                for k in range(len(starts)):
                    seen = Counter(flat[i] for i in places[cuts[k] : cuts[k + 1]].tolist())
                    words.append(b" ".join(seen))
                    times.append(list(seen.values()))
                yield rows(
                    len(starts), row=pa.array(np.arange(row, row + len(starts))), id=batch.column(0).slice(first, len(starts)), held=batch.column(1).slice(first, len(starts)), n=pa.array(size), known=pa.array(known),
                    base=pa.array(base), hot=pa.array(more), rare=pa.array(words, pa.binary()).cast(pa.string()), times=pa.array(times, pa.list_(pa.int64())),
                )
                asked, whose = np.concatenate(asked), np.concatenate(whose)
                order = np.argsort(asked)
                asked, whose = asked[order], whose[order]
                blocks = _blocks((asked >> np.uint64(64 - bits)).astype(np.int32), lambda i: _planes(np.diff(asked[i], prepend=np.uint64(0))) + _planes(whose[i]))  # noqa: B023
                if blocks:
                    parts, n, packed = zip(*blocks, strict=True)
                    yield rows(len(parts), row=pa.array([row] * len(parts)), part=pa.array(parts, pa.int32()), n=pa.array(n, pa.int64()), packed=pa.array(packed, pa.binary()))
                row += len(starts)

    return run


def _answers(asked: pa.Table, worth: pa.Table) -> pa.Table:
    """(row, n, packed) and (code, worth) of one part to (row, states): what a text's n-grams there are worth in all."""
    codes = worth.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    codes, worth, rows, sums = codes[order], worth.column("worth").to_numpy()[order], [], []
    for row, n, packed in zip(asked.column("row").to_pylist(), asked.column("n").to_pylist(), asked.column("packed"), strict=True):
        raw = _raw(packed, 12 * n)
        own = np.cumsum(_values(raw[: 8 * n], np.uint64), dtype=np.uint64)
        at = np.searchsorted(codes, own)
        met = np.flatnonzero(codes[np.minimum(at, len(codes) - 1)] == own) if len(codes) else at[:0]
        whose, of = np.unique(_values(raw[8 * n :], np.int32)[met], return_inverse=True)
        rows.append(row + whose.astype(np.int64))
        sums.append(np.bincount(of, weights=worth[at[met]], minlength=len(whose)))
    return pa.table({"row": pa.array(np.concatenate(rows) if rows else [], pa.int64()), "states": pa.array(np.concatenate(sums) if sums else [], pa.float64())})


def _levels(counted: DataFrame, ones: DataFrame, tokens: int, distinct: int) -> list[DataFrame]:
    """Per context length (code, ctx, c, c_ctx, lp, g, own_g, worth), materialised.

    lp: log10 probability of a kept token, shorter states mixed in; g: G of the context, and own_g the context's own part of
    it (0 unless retained); worth: E less E of the longest suffix.
    """
    root = F.log10((F.col("c") + 0.5) / F.lit(tokens + 0.5 * (distinct + 1)))
    below, out = ones.select(F.col("id").alias("suf"), root.alias("lp_suf"), F.lit(0.0).alias("g_suf")), []
    before = ones.select(F.col("id").alias("ctx"), F.col("c").alias("c_ctx"))
    for n in range(2, DEPTH + 2):
        rows = counted.where(F.col("n") == n).join(below, "suf").join(before, "ctx")
        rows = rows.select("code", "ctx", "c", "c_ctx", "lp_suf", "g_suf", F.pow(F.lit(10.0), "lp_suf").alias("pp"), ((F.col("c") - DISCOUNT) / F.col("c_ctx")).alias("own"))
        of = Window.partitionBy("ctx")
        met = rows.withColumn("left", 1 - F.sum("own").over(of)).withColumn("rest", F.col("c_ctx") - F.sum("c").over(of)).withColumn("k", F.count("*").over(of))
        gain = F.sum(F.col("c") * F.log(F.col("own") / F.col("pp") + F.col("left"))).over(of) + F.col("rest") * F.log("left")
        met = met.withColumn("held", gain > F.col("k") * (math.log(max(tokens, 2)) / 2))
        held = F.col("held")
        lp = F.when(held, F.log10(F.col("own") + F.col("left") * F.col("pp"))).otherwise(F.col("lp_suf"))
        met = met.withColumn("lp", lp).withColumn("own_g", F.when(held, F.log10("left")).otherwise(0.0)).withColumn("g", F.col("g_suf") + F.col("own_g"))
        worth = (F.col("lp") - F.col("g")) - (F.col("lp_suf") - F.col("g_suf"))
        level = cut(met.select("code", "ctx", "c", "c_ctx", "lp", "g", "own_g", F.when(held, worth).otherwise(0.0).alias("worth")))
        out.append(level)
        below = level.select(F.col("code").alias("suf"), F.col("lp").alias("lp_suf"), F.col("g").alias("g_suf"))
        before = level.select(F.col("code").alias("ctx"), F.col("c").alias("c_ctx"))
    return out


def _bin(c: str):
    """A class of counts, sixteen to each power of two."""
    return F.floor(F.log2(c) * 16).cast("int")


def _most(sizes: dict[int, int], most: int) -> int:
    """The smallest class such that it and those above hold at most ``most``."""
    held, at = 0, max(sizes, default=0) + 1
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        at = k
    return at


def _power(n: float, least: int, most: int) -> int:
    return min(max(math.ceil(math.log2(max(n, 1))), least), most)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) to (id, c): words' hashes."""
    for batch in batches:
        ids = _hash(batch.column(0).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), batch.column(1)], ["id", "c"])


def _mark(bits: int):
    """(code) to (chunk, n, packed) of the two buckets of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy().view(np.uint64)
            if len(codes):
                yield _met(np.concatenate([_bucket(codes, bits, mix).astype(np.uint32) for mix in (_MIX, _MIX2)]))

    return run


def _bitmap(met: DataFrame, least: int, bits: int) -> np.ndarray:
    """The buckets of 2^bits that (chunk, n, packed) have ``least`` times in all; at most 128 MB."""
    reached = met.groupBy("chunk").applyInArrow(_reach(least), "chunk int, bits binary").toArrow()
    out, width = np.zeros(1 << (bits - 6), dtype=np.uint64), 1 << (CHUNK - 6)
    for k, part in zip(reached.column("chunk").to_pylist(), reached.column("bits"), strict=True):
        out[k * width : (k + 1) * width] = np.frombuffer(part.as_buffer(), dtype=np.uint64)
    return out


def _worth(levels: list[DataFrame]) -> DataFrame:
    """(code, c, last, ctx): what an n-gram adds to its last token, and as a state to the token after it, where either is not 0."""
    out = None
    for level in levels:
        last = level.where("worth <> 0").select("code", "c", F.col("worth").alias("last"), F.lit(0.0).alias("ctx"))
        states = level.where("own_g <> 0").groupBy(F.col("ctx").alias("code")).agg(F.first("c_ctx").alias("c"), F.lit(0.0).alias("last"), F.first("own_g").alias("ctx"))
        rows = last.unionByName(states)
        out = rows if out is None else out.unionByName(rows)
    return cut(out.groupBy("code").agg(F.max("c").alias("c"), F.sum("last").alias("last"), F.sum("ctx").alias("ctx")))


def train(trained: DataFrame) -> tuple[DataFrame, Model, int, int, DataFrame]:
    """Rare words (word, c), what tasks score with, N, V and what other n-grams are worth (code, worth), from rows (text)."""
    spark = trained.sparkSession
    vocabulary = cut(trained.mapInArrow(count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0)).alias("ends")).first()
    least = max(LEAST, math.ceil(SHARE * sums.n))
    words = vocabulary.where(F.col("word") != "")
    common = _most({r.b: r.n for r in words.groupBy(_bin("c").alias("b")).agg(F.count("*").alias("n")).collect()}, HOT_WORDS)  # at most 16 rows a power of two
    often = words.where(_bin("c") >= common).orderBy(F.desc("c"), "word").toArrow()  # at most HOT_WORDS words
    hot = [w.encode() for w in often.column("word").to_pylist()]
    counts = np.concatenate(([0, 0, sums.ends], often.column("c").to_numpy())).astype(np.int64)
    numbers = {b" ": START, b"": END} | dict(zip(hot, range(END + 1, END + 1 + len(hot)), strict=True))
    hashes = np.concatenate((np.zeros(1, np.uint64), _hash([b" ", b"", *hot])))
    held = spark.sparkContext.broadcast((numbers, hashes))
    bits = _power(sums.n, CHUNK, BITS)
    marks = spark.sparkContext.broadcast(_bitmap(trained.mapInArrow(_sketch(held, bits), "chunk int, n int, packed binary"), least, bits + 1))
    found = trained.mapInArrow(_count(held, marks, bits, 1 << _power(sums.n / PART, 0, 12)), "part int, numbered boolean, n int, packed binary")
    counted = cut(found.groupBy("part").applyInArrow(_total(held, least), "n int, code long, ctx long, suf long, c long"))
    for sent in (marks, held):  # their copies on every machine; what they gave is materialised
        sent.destroy()
    start = spark.createDataFrame(pa.table({"id": hashes[START : START + 1].view(np.int64), "c": np.array([sums.ends], np.int64)}))  # a start before every text
    ones = cut(vocabulary.where(F.col("c") >= least).mapInArrow(_numbers, "id long, c long").unionByName(start))
    worth = _worth(_levels(counted, ones, sums.n, sums.v))
    classes = worth.groupBy(_bin("c").alias("b")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("ctx") != 0, 1).otherwise(0)).alias("states")).collect()
    at = _most({r.b: r.n for r in classes}, HOT)
    table = worth.where(_bin("c") >= at).select("code", "last", "ctx").toArrow()  # at most HOT n-grams
    codes = table.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    rest, n = worth.where(_bin("c") < at), sum(r.n for r in classes if r.b < at)
    others = np.zeros(0, dtype=np.uint64)
    if n:
        wide = _power(32 * n, CHUNK, BITS)
        others = _bitmap(rest.select("code").mapInArrow(_mark(wide), "chunk int, n int, packed binary"), 1, wide)
    root = np.log10((counts + 0.5) / (sums.n + 0.5 * (sums.v + 1)))
    model = Model(numbers, hashes, counts, root, (codes[order], table.column("last").to_numpy()[order], table.column("ctx").to_numpy()[order]), others, sum(r.states for r in classes))
    return words.where(_bin("c") < common), model, sums.n, sums.v, rest.select("code", (F.col("last") + F.col("ctx")).alias("worth"))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, and n_states, the size of the tree."""
    text = F.col(text_col).cast("string")
    remainder = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (remainder == 1).alias("held"), text.alias("text"))
    words, model, tokens, distinct, worth = train(rows.where(~F.col("held")).select("text"))
    state = docs.sparkSession.sparkContext.broadcast(model.slim())
    schema = "row long, id long, held boolean, n long, known long, base double, hot double, rare string, times array<long>, part int, packed binary"
    bits = _power(tokens / ASKED, 1, 20)
    met = cut(rows.mapInArrow(_rows(state, bits), schema))
    scored = met.where("part IS NULL")
    pairs = F.explode(F.arrays_zip(F.split("rare", " ").alias("word"), F.col("times").alias("times"))).alias("x")
    rare = scored.where("rare <> ''").select("row", pairs).select("row", F.col("x.word").alias("word"), F.col("x.times").alias("m"))
    known = rare.join(words, "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(tokens + 0.5 * (distinct + 1)))
    of_words = known.select("row", (F.col("m") * log).alias("more"), F.when(F.col("c") > 0, F.col("m")).otherwise(0).alias("found"), F.lit(0.0).alias("states"))
    asked = met.where("part IS NOT NULL").select("part", "row", "n", "packed").groupBy("part")
    told = asked.cogroup(worth.withColumn("part", F.shiftrightunsigned("code", 64 - bits).cast("int")).groupBy("part")).applyInArrow(_answers, "row long, states double")
    of_states = told.select("row", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("found"), "states")
    more = of_words.unionByName(of_states).groupBy("row").agg(F.sum("more").alias("more"), F.sum("found").alias("found"), F.sum("states").alias("states"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    return scored.join(more, "row", "left").select(
        "id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("hot") + F.coalesce("states", F.lit(0.0))).alias("score"), F.lit(model.n_states).cast("long").alias("n_states"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (and n_states)."""
    return scores(docs).withColumnRenamed("id", "doc_id")
