"""Conversation prefix trie in balanced parentheses.

Turns are ordered in each conversation, and a prefix of d turns is known by 128 bits: an exclusive or over hashes of
(place, role and text), which a running window adds up. Prefixes with the same bits are one node. The nodes whose members
have the same smallest conversation r and the same number n lie on one chain without branches, so the pair (r, n) names the
chain, and only its lowest node goes into the encoding. A conversation then is the short list of the chains it passes; the
list is as long as the places where others leave it, however long the conversation.

The lists are range-sorted, which is the trie's depth-first order, and each task takes its range in shards of at most
``SHARD`` conversations. A shard is encoded in balanced parentheses. Blocks of excess values with a tree of their minima
answer findclose, which delimits a node's subtree; the rank of leaf pairs ``()`` between the two counts its leaves, and
cumulative arrays over preorder give the savings in it. Chains that several shards share, the spines at the cuts, are merged
by adding; what a chain contributes itself counts where its smallest conversation lies. Conversations that end in a node lie
together and in order, so their digest is taken over a few pieces.

Every conversation may be rebuilt first (``rebuilt``), from the first turns of another one and its own later ones.

Defined results: null roles and texts are empty; null turns come first; turns of one conversation that share a number are
ordered by a digest of role and text; rows with a null conversation id take no part; repeated rows are turns of their own; a
conversation that is rebuilt without turns is a member of the root alone; an empty table gives no nodes; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.session import cut

#: Conversations of a shard, and excess values of a block.
SHARD, BLOCK = 1 << 17, 64
HEADS = 5
_FAR = np.iinfo(np.int32).max
ELEMENT = ["d", "h1", "h2", "n", "r", "total", "leaf"]


def turns(conversations: DataFrame) -> DataFrame:
    """(c, p, key, n): place from 0, a digest of role and text, and the text's code points."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.length(text).cast("long").alias("n"))
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.asc_nulls_first("turn"), "key")) - 1
    return rows.select("c", place.cast("long").alias("p"), "key", "n")


def rebuilt(placed: DataFrame) -> DataFrame:
    """(c, d, key, n), d from 1, and a row with d = 0 for each conversation: the first h turns of c - c % 100, then c's own from h on."""
    placed = cut(placed)
    heads = placed.where(F.col("p") < HEADS).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("p", "key", "n"))).alias("head"))  # at most HEADS
    h = F.crc32(F.col("c").cast("string")) % (HEADS + 1)
    known = placed.groupBy("c").agg(F.count("*").alias("own")).select("c", h.cast("int").alias("h"), (F.col("c") - F.col("c") % 100).alias("base"))
    met = known.join(heads.withColumnRenamed("c", "base"), "base", "left")
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("head", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    convs = cut(met.select("c", "h", head.alias("head")))
    first = convs.select("c", F.posexplode("head").alias("at", "x")).select("c", (F.col("at") + 1).cast("long").alias("d"), "x.key", "x.n")
    size = F.coalesce(F.size("head"), F.lit(0))
    sizes = convs.select("c", "h", F.when(size > 0, size).otherwise(0).alias("size"))
    later = placed.join(sizes, "c").where(F.col("p") >= F.col("h")).select("c", (F.col("p") - F.col("h") + F.col("size") + 1).alias("d"), "key", "n")
    root = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("n"))
    return root.unionByName(first).unionByName(later)


class Excess:
    """Excess of balanced parentheses in blocks, with a tree of block minima."""

    def __init__(self, bits: np.ndarray):
        excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int32)
        blocks = max(1, -(-len(bits) // BLOCK))
        self.width = 1 << (blocks - 1).bit_length()
        self.excess = np.full(self.width * BLOCK, _FAR, dtype=np.int32)
        self.excess[: len(bits)] = excess
        self.levels = [self.excess.reshape(-1, BLOCK).min(1)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(1))

    def _scan(self, at: np.ndarray, target: np.ndarray, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Looks on from ``at`` to its block's end; returns what is still open of ``rows``."""
        while len(rows):
            hit = self.excess[at] <= target[rows]
            out[rows[hit]] = at[hit]
            go = ~hit & ((at + 1) % BLOCK != 0)
            lost = rows[~hit & ~go]
            if len(lost):
                out[lost] = -1
            at, rows = at[go] + 1, rows[go]
        return np.flatnonzero(out < 0)

    def close(self, p: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        target, out = self.excess[p] - 1, np.full(len(p), -2, dtype=np.int64)
        inside = np.flatnonzero((p + 1) % BLOCK != 0)
        self._scan(p[inside] + 1, target, out, inside)
        open_ = np.flatnonzero(out < 0)
        node, start, depth = p[open_] // BLOCK, np.zeros(len(open_), dtype=np.int64), np.full(len(open_), -1)
        for level, least in enumerate(self.levels):
            free = np.flatnonzero(depth < 0)
            if not len(free):
                break
            right = node[free] | 1
            met = (node[free] % 2 == 0) & (right < len(least)) & (least[np.minimum(right, len(least) - 1)] <= target[open_[free]])
            start[free[met]], depth[free[met]] = right[met], level
            node[free[~met]] //= 2
        for level in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(depth == level)
            left = 2 * start[down]
            start[down] = np.where(self.levels[level - 1][left] <= target[open_[down]], left, left + 1)
            depth[down] = level - 1
        out[open_] = -2
        self._scan(start * BLOCK, target, out, open_)
        return out


def encode(conv: np.ndarray, size: np.ndarray, e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """One shard: sorted lists of chains (``size`` elements each, columns ``e``) to a row per chain, and which lists differ from the one before."""
    offset = np.concatenate(([0], np.cumsum(size)))[:-1]
    seq = np.repeat(np.arange(len(size)), size)
    level = np.arange(len(seq)) - offset[seq]
    prev = np.where(seq > 0, offset[seq - 1] + level, 0)
    there = (seq > 0) & (level < size[seq - 1])
    prev = np.where(there, prev, 0)
    differs = ~there | (e["d"] != e["d"][prev]) | (e["h1"] != e["h1"][prev]) | (e["h2"] != e["h2"][prev])
    run = np.cumsum(differs)
    opened = run - (run - differs)[offset][seq] > 0
    opens = np.bincount(seq[opened], minlength=len(size))
    closes = np.concatenate(([0], size[:-1] - (size - opens)[1:]))
    # the parentheses: before each list its predecessor's chains close, then its own open; at the end all close
    counts = np.column_stack((closes, opens)).ravel()
    bits = np.repeat(np.tile([False, True], len(size)), counts)
    bits = np.concatenate((bits, np.zeros(int(size[-1]), dtype=bool)))
    p = np.flatnonzero(bits)
    end = Excess(bits).close(p)
    at = np.flatnonzero(opened)
    own = np.isin(e["r"][at], conv)
    pair = np.zeros(len(bits) + 1, dtype=np.int64)
    pair[p] = ~bits[p + 1] & e["leaf"][at] & own
    rank = np.cumsum(pair) - pair
    before = np.cumsum(bits) - bits  # openings before a place: a subtree is a run of preorder numbers
    up = np.maximum(at - 1, 0)
    top = level[at] == 0
    weight = np.where(own, (e["n"][at] - 1) * (e["total"][at] - np.where(top, 0, e["total"][up])), 0)
    sums = np.concatenate(([0], np.cumsum(weight)))
    # the parent is the last chain that opened one level up
    number, many = np.arange(len(at)), len(at) + 1
    keys = level[at] * many + number
    order = np.argsort(keys, kind="stable")
    found = np.searchsorted(keys[order], (level[at] - 1) * many + number) - 1
    parent = order[np.maximum(found, 0)]
    children = np.bincount(parent[~top & own], minlength=len(at))
    rows = {
        "r": e["r"][at], "n": e["n"][at], "d": e["d"][at], "total": e["total"][at], "leaves": rank[end] - rank[p], "below": sums[before[end]] - sums[number] - weight,
        "children": children, "d_up": np.where(top, -1, e["d"][up]), "r_up": e["r"][up],
    }
    return rows, np.concatenate(([True], (opens[1:] > 0) | (closes[1:] > 0)))


SHARDED = "r long, n long, d long, total long, leaves long, below long, children long, d_up long, r_up long, first long, ids string"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        conv, lists = table.column("c").to_numpy(), table.column("seq").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        size, items = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        e = {name: items.field(name).to_numpy(zero_copy_only=False) for name in ELEMENT}
        rows, changed = encode(conv, size, e)
        columns = {name: pa.array(x.astype(np.int64)) for name, x in rows.items()}
        none = pa.nulls(len(rows["r"]), pa.int64())
        yield pa.RecordBatch.from_pydict(columns | {"first": none, "ids": pa.nulls(len(none), pa.string())})
        last = np.cumsum(size) - 1
        begin = np.flatnonzero(changed)
        stop = np.append(begin[1:], len(conv))
        node = last[begin]
        ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(begin, stop, strict=True)]
        columns = {name: pa.nulls(len(begin), pa.int64()) for name in rows} | {"r": pa.array(e["r"][node]), "n": pa.array(e["n"][node]), "first": pa.array(conv[begin]), "ids": pa.array(ids, pa.string())}
        yield pa.RecordBatch.from_pydict(columns)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= SHARD:
            yield from out(held)
            held, n = [], 0
    if n:
        yield from out(held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, n, first, ids), sorted, to (r, n, sha): pieces are hashed as they come."""
    now, state, done = None, None, []
    for batch in batches:
        for r, n, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (r, n) != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (r, n), hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if len(done) > 10_000:
            yield _digested(done)
            done = []
    if now is not None:
        done.append((*now, state.hexdigest()))
    if done:
        yield _digested(done)


def _digested(rows: list[tuple]) -> pa.RecordBatch:
    r, n, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(n, pa.int64()), pa.array(sha)], ["r", "n", "sha"])


def trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of ``rows`` (c, d, key, n), which has a row with d = 0 for each conversation."""
    path = Window.partitionBy("c").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    next_ = Window.partitionBy("c").orderBy("d")
    prefixes = cut(rows.select(
        "c", "d", "n", F.bit_xor(F.xxhash64("d", "key")).over(path).alias("h1"), F.bit_xor(F.xxhash64(F.lit("second"), "key", "d")).over(path).alias("h2"),
        F.sum("n").over(path).alias("total"), F.lead("d").over(next_).isNull().cast("long").alias("last"),
    ))
    nodes = cut(prefixes.groupBy("d", "h1", "h2").agg(F.count("*").alias("n"), F.min("c").alias("r"), F.max("n").alias("len"), F.max("total").alias("total"), F.sum("last").alias("ends")))
    lowest = F.max_by(F.struct("d", "h1", "h2", "total", (F.col("ends") == F.col("n")).alias("leaf")), "d").alias("x")
    chains = cut(nodes.groupBy("r", "n").agg(lowest).select("r", "n", "x.*"))
    shared = prefixes.select("c", "d", "h1", "h2").join(chains.where("n > 1"), ["d", "h1", "h2"]).select("c", *ELEMENT)
    alone = chains.where("n = 1").select(F.col("r").alias("c"), *ELEMENT)
    lists = cut(shared.unionByName(alone).groupBy("c").agg(F.array_sort(F.collect_list(F.struct(*ELEMENT))).alias("seq")))
    found = cut(lists.repartitionByRange("seq", "c").sortWithinPartitions("seq", "c").mapInArrow(_shards, SHARDED))
    merged = found.where("ids IS NULL").groupBy("r", "n").agg(
        F.max("d").alias("d_low"), F.max("total").alias("t_low"), F.sum("leaves").alias("leaves"), F.sum("below").alias("below"), F.sum("children").alias("children"),
        F.max("d_up").alias("d_up"), F.max("r_up").alias("r_up"),
    )
    ends = found.where("ids IS NOT NULL").select("r", "n", "first", "ids").repartition("r", "n").sortWithinPartitions("r", "n", "first").mapInArrow(_digests, "r long, n long, sha string")
    low = F.col("d") == F.col("d_low")
    return nodes.join(merged.join(ends, ["r", "n"], "left"), ["r", "n"]).select(
        F.col("r").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") > 0, F.when(F.col("d") == F.col("d_up") + 1, F.col("r_up")).otherwise(F.col("r"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(low, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("t_low") - F.col("total") + F.col("len"))).alias("saved_tokens"),
        F.coalesce(F.when(low, F.col("sha")), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's rows: a row per node of the rebuilt conversations."""
    return trie(rebuilt(turns(conversations)))
