"""SentencePiece encoding and decoding by suffix-array matching.

Per batch, the distinct units of the normalised texts (a word with the space marks before it; no piece of the model crosses
from one to the next) are laid end to end, and a suffix array over that text is built by prefix doubling. Every piece is
found by binary search, all pieces at once and a symbol deeper each step, which gives its range of occurrences. The ranges
expand to edges (position, length, piece), laid out by position. Then edges are relaxed: the model is a byte-pair one, whose
result is not a cheapest path, so relaxation goes in the model's own order: in each round every unit takes the edge of best
score that joins two adjacent segments, leftmost first, until none is left. Symbols without a piece become byte pieces.

Defined results: a null text is empty and has no ids; units of over ``LONG`` symbols go through a heap, which takes
n log n steps; whole texts are read; repeated rows are encoded one by one; an empty table gives no rows; other columns are
not read. Decoding joins pieces and drops the space that encoding puts first.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import texts

MODEL, SPACE, LONG = "piece_bpe_32k.model", "▁", 256
#: Symbols of one suffix array, and distinct units that a task remembers.
SYMBOLS, UNITS = 400_000, 1 << 19
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Codec:
    def __init__(self, name: str = MODEL):
        import public_tokenizers
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this model crosses words")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.place = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        self.out = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([self.bytes.index(i)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.longest = max(map(len, self.ids))
        # pieces in order, as rows of symbols padded with zeros
        self.order = sorted(self.ids)
        self.piece_ids = np.array([self.ids[p] for p in self.order])
        self.lengths = np.array([len(p) for p in self.order])
        self.symbols = np.zeros((len(self.order), self.longest), dtype=np.int64)
        for k, p in enumerate(self.order):
            self.symbols[k, : len(p)] = np.frombuffer(p.encode("utf-32-le"), dtype="<u4")

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Piece at each (position, length), or -1; ``codes`` are symbols with zeros between units."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(self.longest + 1, dtype=np.int64)])
        _, rank = np.unique(padded, return_inverse=True)
        # several symbols fit one integer, so the first sort goes by more than one of them
        bits = max(1, int(rank.max()).bit_length())
        width = min(63 // bits, self.longest)
        symbols = np.concatenate([rank, np.zeros(width, dtype=rank.dtype)]).astype(np.int64)
        key = np.zeros(len(rank), dtype=np.int64)
        for k in range(width):
            key = key << bits | symbols[k : k + len(rank)]
        _, rank = np.unique(key, return_inverse=True)
        while width < self.longest:
            key = rank.astype(np.int64) * (len(rank) + 1)
            key[:-width] += rank[width:] + 1
            _, rank = np.unique(key, return_inverse=True)
            width *= 2
        suffixes = np.argsort(rank[:n], kind="stable")
        table = np.full((n, self.longest + 1), -1, dtype=np.int32)
        group = np.zeros(n, dtype=np.int64)  # of suffixes that agree so far, ascending along the array
        low, high = np.zeros(len(self.order), dtype=np.int64), np.full(len(self.order), n, dtype=np.int64)
        for depth in range(self.longest):
            key = group << 21 | padded[suffixes + depth]
            alive = (self.lengths > depth) & (low < high)
            if not alive.any():
                break
            wanted = group[np.minimum(low[alive], n - 1)] << 21 | self.symbols[alive, depth]
            low[alive], high[alive] = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
            done = alive & (self.lengths == depth + 1) & (low < high)
            count = high[done] - low[done]
            at = suffixes[np.repeat(low[done] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
            table[at, depth + 1] = np.repeat(self.piece_ids[done], count)
            group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if n else group
        return table

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit."""
        out: list = [None] * len(units)
        held, size = [], 0
        for k, unit in enumerate(units):
            if len(unit) > LONG:
                out[k] = self.encode_long(unit)
                continue
            held.append(k)
            size += len(unit) + 1
            if size >= SYMBOLS:
                self._relax(units, held, out)
                held, size = [], 0
        self._relax(units, held, out)
        return out

    def _relax(self, units: list[str], held: list[int], out: list) -> None:
        if not held:
            return
        codes = np.frombuffer("".join(units[k] + "\0" for k in held).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        table = self.edges(codes)
        starts = np.flatnonzero(codes)
        owner = np.cumsum(codes == 0)[starts]
        open_ = np.arange(len(starts))  # segments of units that may still change, in order
        lengths = np.ones(len(starts), dtype=np.int64)
        live = np.ones(len(starts), dtype=bool)
        while len(open_) > 1:
            a, b = open_[:-1], open_[1:]
            joined = lengths[a] + lengths[b]
            fits = (owner[a] == owner[b]) & (joined <= self.longest)
            piece = np.where(fits, table[starts[a], np.minimum(joined, self.longest)], -1)
            at = np.flatnonzero(piece >= 0)
            if not len(at):
                break
            own = owner[a[at]]
            # units lie one after another, so the best edge of each is a minimum over a run: by score, then by place
            runs = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            chosen = np.minimum.reduceat(self.place[piece[at]] << 32 | at, runs) & 0xFFFFFFFF
            lengths[a[chosen]] += lengths[b[chosen]]
            live[b[chosen]] = False
            changing = np.zeros(int(owner[-1]) + 2, dtype=bool)
            changing[owner[a[chosen]]] = True
            open_ = open_[live[open_] & changing[owner[open_]]]
        kept = np.flatnonzero(live)
        ids = table[starts[kept], lengths[kept]].astype(np.int32)
        cuts = np.searchsorted(owner[kept], np.arange(len(held) + 1)).tolist()
        missing = set(owner[kept[ids < 0]].tolist())
        for j, k in enumerate(held):
            part = ids[cuts[j] : cuts[j + 1]]
            if j in missing:
                unit, fixed, place = units[k], [], 0
                for i, n in zip(part.tolist(), lengths[kept[cuts[j] : cuts[j + 1]]].tolist(), strict=True):
                    fixed += [i] if i >= 0 else [self.bytes[b] for b in unit[place : place + n].encode()]
                    place += n
                part = np.array(fixed, dtype=np.int32)
            out[k] = part

    def encode_long(self, unit: str) -> np.ndarray:
        """The same merges for one unit, by a heap over adjacent segments."""
        n = len(unit)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(unit[a : end[b]])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, end[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        gone = bytearray(n)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if gone[a] or gone[b] or after[a] != b or end[b] != stop:
                continue
            end[a], gone[b], after[a] = stop, 1, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[int] = []
        for k in range(n):
            if not gone[k]:
                i = self.ids.get(unit[k : end[k]])
                out += [i] if i is not None else [self.bytes[b] for b in unit[k : end[k]].encode()]
        return np.array(out, dtype=np.int32)

    def normalised(self, text: str) -> str:
        return self.sp.normalize(text)

    def decode(self, ids: np.ndarray) -> str:
        whole = b"".join(map(self.out.__getitem__, ids.tolist()))
        return whole.decode("utf-8", "replace").removeprefix(" ")


def _encode(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    codec, known = Codec(), {}
    for batch in batches:
        for first, held in texts(batch.column(1), 1 << 22):
            split = [_UNIT.findall(codec.normalised(t.decode())) if t else [] for t in held]
            fresh = list(set().union(*split) - known.keys())
            if len(known) + len(fresh) > UNITS:
                known, fresh = {}, list(set().union(*split))
            known.update(zip(fresh, codec.encode_units(fresh), strict=True))
            ids = [np.concatenate([known[u] for u in units]) if units else np.zeros(0, dtype=np.int32) for units in split]
            doc = batch.column(0).slice(first, len(held))
            n = pa.array([len(x) for x in ids], pa.int64())
            if with_ids:
                yield pa.RecordBatch.from_arrays([doc, n, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_ids", "ids"])
                continue
            crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
            back = [codec.decode(x) for x in ids]
            sha = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back])
            same = pa.array([b.encode() == t for b, t in zip(back, held, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([doc, n, crc, sha, same], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])


def _selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids) per row."""
    return _selected(docs, id_col, text_col).mapInArrow(lambda batches: _encode(batches, True), "doc_id long, n_ids long, ids array<int>")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            out = [None if x is None else codec.decode(np.array(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long"), ids_col).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_ids, a CRC-32 of the ids, a digest of the text decoded from them, and whether it is the text."""
    return _selected(docs, "doc_id", "text").mapInArrow(lambda batches: _encode(batches, False), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
