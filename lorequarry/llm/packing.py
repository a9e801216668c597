"""Packing of documents into token windows by an order-preserving dynamic programme.

A shard (one task's rows, sorted by id) is a stream of tokens: every document's ids and one end id. Windows cut the stream
in order. Cuts may fall at document ends (free), sentence ends (a small penalty) or, where neither comes for ``GRID``
tokens, within a sentence (a larger one). The programme minimises padding plus penalties:

    cost(j) = penalty(j) + min over i with p(j) - p(i) <= size of cost(i) + size - (p(j) - p(i)),

and with ``f(i) = cost(i) + p(i)`` the inner minimum is that of a sliding window, kept in a monotone queue: linear time.
The programme runs over blocks of a stream; the last windows of a block are reopened with the next, so memory does not
grow with the shard. The tail of a shard is cut into powers of two, which need no padding, when that costs less.

Ids are those of the byte-level BPE vocabulary file; its rank form gives the same ids some four times as fast, which the
tests hold against the other library on whole texts.

Defined results: a null or empty text is its end id alone; very long texts run over many windows; rows that repeat are
packed one by one; null ids pass through; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import texts

SIZE, END_ID, GRID = 2048, 1, 8
SENTENCE_PENALTY, WORD_PENALTY = 1, 4
#: Tokens of a block, and how many of its last windows are reopened with the next.
BLOCK, REOPENED = 1 << 20, 4
_END, _CLOSE, _SPACE = 1, 2, 3
_KINDS = np.zeros(256, dtype=np.uint8)
for _kind, _bytes in ((_END, b".!?"), (_CLOSE, b"\"')]"), (_SPACE, b" \t\n\r\x0b\x0c")):
    _KINDS[list(_bytes)] = _kind
_PRICES = np.array([0, WORD_PENALTY, SENTENCE_PENALTY, 0])
#: Bytes of text in a run whose candidates are found at once.
RUN = 1 << 22
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids and byte lengths of the vocabulary file ``name``.tiktoken; its special token keeps its id in texts."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": len(ranks)}
        self._encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(len(ranks) + 1, dtype=np.int64)
        for token, i in (ranks | {k.encode(): v for k, v in special.items()}).items():
            self.lengths[i] = len(token)

    def ids(self, text: bytes) -> np.ndarray:
        """Ids of a text and the end id."""
        found = self._encoding.encode_to_numpy(text.decode(), allowed_special="all")
        return np.append(found, np.array([END_ID], dtype=found.dtype))


def sentence_ends(data: np.ndarray) -> np.ndarray:
    """Byte offsets where a sentence ends: before a space that follows end marks and closing marks, and after a line feed."""
    kind = _KINDS[data]
    space = np.flatnonzero(kind == _SPACE)
    # the last byte before each space that is no closing mark decides
    other = np.maximum.accumulate(np.where(kind == _CLOSE, -1, np.arange(len(data))))
    space_ = space[space > 0]
    before = other[space_ - 1]
    ended = space_[(before >= 0) & (kind[before] == _END)]
    return np.union1d(ended, np.flatnonzero(data == 10) + 1)


def candidates(held: list[bytes], ids: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token offsets in a run of documents (each with its end id) where a cut may fall, and what each costs.

    A zero byte stands between documents, as long as the end id's single place, so that bytes and tokens stay aligned.
    """
    sizes = np.fromiter((len(x) for x in ids), dtype=np.int64, count=len(ids))
    tokens = np.concatenate(ids)
    width = lengths[tokens]
    stops = np.cumsum(sizes)
    width[stops - 1] = 1  # the end ids
    data = np.frombuffer(b"\0".join(held) + b"\0", dtype=np.uint8)
    kind = np.zeros(len(tokens) + 1, dtype=np.int8)  # 0: no cut, 1: within a sentence, 2: sentence end, 3: document end
    kind[np.searchsorted(np.cumsum(width), sentence_ends(data)) + 1] = 2
    kind[stops] = 3
    known = np.concatenate(([0], np.flatnonzero(kind)))
    inner = (np.diff(known) - 1) // GRID
    step = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    kind[np.repeat(known[:-1], inner) + GRID * step] = 1
    places = np.flatnonzero(kind)
    return places, _PRICES[kind[places]]


def cuts(places: list[int], price: list[int], size: int = SIZE, ended: bool = True) -> list[int]:
    """Indices of the chosen cuts over candidates at ascending ``places`` (the first is the start, the last the end).

    A stream that has not ended is cut up to the cheapest candidate within a window of its end, so that no padding is
    taken only because a block stops there.
    """
    m = len(places)
    back, f, queue = [0] * m, [0] * m, deque([0])
    for j in range(1, m):
        least = places[j] - size
        while places[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        back[j] = i
        here = f[j] = f[i] + size + price[j]
        while queue and f[queue[-1]] > here:
            queue.pop()
        queue.append(j)
    out, j = [], m - 1
    if not ended:
        k = j
        while k and places[k] > places[-1] - size:
            if f[k] - places[k] < f[j] - places[j]:
                j = k
            k -= 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


class _Shard:
    """The open end of a stream: token arrays of the documents not yet wholly cut, and the candidates over them."""

    def __init__(self, shard: int):
        self.docs: list[tuple] = []  # (doc_id, doc_tokens, its offset at the start, ids)
        self.places, self.price, self.size = [0], [0], 0
        self.sequence = shard << 32

    def add(self, doc_ids: list, ids: list[np.ndarray], places: np.ndarray, price: np.ndarray) -> None:
        self.docs += [(doc_id, len(x), 0, x) for doc_id, x in zip(doc_ids, ids, strict=True)]
        self.places += (places + self.size).tolist()
        self.price += price.tolist()
        self.size += sum(map(len, ids))

    def settle(self, last: bool) -> list[tuple]:
        """Rows of the windows that are certain: all but the last few, or all at the end of the shard."""
        if not self.size:
            return []
        chosen = [self.places[k] for k in cuts(self.places, self.price, ended=last)]
        if last:
            chosen = self._tail(chosen)
        else:
            chosen = chosen[:-REOPENED]
        rows, k, begin = [], 0, 0
        at = 0  # stream offset of docs[k]
        for end in chosen:
            offset = 0
            while begin < end:
                doc_id, total, start, ids = self.docs[k]
                take = min(end, at + len(ids)) - begin
                piece = ids[begin - at : begin - at + take]
                rows.append((doc_id, start + begin - at, take, zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence, offset))
                begin, offset = begin + take, offset + take
                if begin == at + len(ids):
                    at, k = at + len(ids), k + 1
            self.sequence += 1
        self._drop(begin, at, k)
        return rows

    def _tail(self, chosen: list[int]) -> list[int]:
        first = chosen[-2] if len(chosen) > 1 else 0
        left = self.size - first
        if SIZE - left <= WORD_PENALTY * (left.bit_count() - 1):
            return chosen
        out, at = chosen[:-1], first
        for bit in range(left.bit_length() - 1, -1, -1):
            if left >> bit & 1:
                at += 1 << bit
                out.append(at)
        return out

    def _drop(self, begin: int, at: int, k: int) -> None:
        docs = self.docs[k:]
        if docs and begin > at:
            doc_id, total, start, ids = docs[0]
            docs[0] = (doc_id, total, start + begin - at, ids[begin - at :])
        keep = next((i for i, p in enumerate(self.places) if p >= begin), len(self.places))
        self.docs, self.price = docs, self.price[keep:] or [0]
        self.places = [p - begin for p in self.places[keep:]] or [0]
        self.size -= begin


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder()
    context = TaskContext.get()
    shard = _Shard(context.partitionId() if context else 0)
    for batch in batches:
        ids_of = batch.column(0).to_pylist()
        for first, held in texts(batch.column(1), RUN):
            ids = [encoder.ids(text) for text in held]
            shard.add(ids_of[first : first + len(held)], ids, *candidates(held, ids, encoder.lengths))
            if shard.size >= BLOCK and (rows := shard.settle(False)):
                yield _batch(rows)
    if rows := shard.settle(True):
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents and their places in windows of at most 2048 tokens.

    One narrow pass: shards are the rows as they lie in partitions, sorted by id and text, so a retried task cuts alike.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.sortWithinPartitions("doc_id", "text").mapInArrow(_pack, PIECES)
