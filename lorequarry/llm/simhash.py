"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit of a part of the fingerprint gets a label, a vector over GF(2) of ``radius + 1`` entries; a mask per nonzero vector
keeps the bits whose label has an odd product with it. Any ``radius`` labels leave some vector orthogonal to all of them, so
whichever bits differ between two fingerprints within the radius, some mask drops all of them and the two agree in that
table. Several parts each cover their own radius: of the bits that differ in ``parts * (radius + 1) - 1`` places, some part
has at most ``radius``, so no pair within that many bits can be missed.

Fingerprints are reduced to distinct ones before any search. Small buckets of a table are compared whole batches at a time;
a bucket with more than one near pair is searched breadth first, each step taking one fingerprint against those not yet
reached, so a bucket hands on fewer links than it has members and still joins exactly what its links join. A few tables
are searched first and label nodes by their least neighbour, so that a large group is not linked once more by every table. A bucket of
more than ``BUCKET`` distinct fingerprints is named instead, and then dealt into pairs of blocks, each a group of its own.
Links become components in Spark.

Where a similarity is asked for too, fingerprints have 128 bits of distinct shingles, tables take their four quarters with
a radius of 4 each (every pair within 19 bits meets), pairs that meet are joined up to ``REACH`` bits, and those components
only bound the search: each is then searched by reach and exact Jaccard similarity of whole shingle sets at once, and only
a member that passes both is taken out of the search, so links join exactly what pairs with both properties join.

Defined results: null and empty texts have fingerprint zero and link like any other; a text with fewer words than a
shingle is one shingle; rows with a null id count but name no component; repeated rows have equal rows; an empty table
gives no rows; other columns are not read. ``near_dedup`` keeps all columns, whatever their names; of rows that repeat an
id all stay if the id is its component's smallest, and none otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import BROADCAST_ROWS, cut_narrow, texts, without
from lorequarry.llm.components import components
from lorequarry.session import cut

BUCKET = 16_384
#: Buckets up to this size are compared many at a time.
SMALL = 64
#: Every which table goes first.
EARLY = 12
#: Bits of 128 that may differ between texts of similarity 0.8: the mean is 19.4 and the standard deviation 4.
REACH = 32
#: Bytes of shingle sets in a block of a group of which similarities are computed.
SET_BYTES = 1 << 25
_OFFSETS = np.arange(8) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit majority of unsigned 64-bit hashes: a bit is set in over half of them."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (counts @ _BITS).ravel()) > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Hashes for a further word of the fingerprint, as good as independent of the first."""
    if not word:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * word % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, repeats included, lower-cased in A-Z and joined by spaces."""
    import xxhash

    words = text.lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    joined, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    h, starts = xxhash.xxh64_intdigest, [0, *(e + 1 for e in ends[: -width])]
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=True)), dtype=np.uint64, count=len(starts))


def masks(radius: int, parts: int = 1, bits: int = 64) -> list[int]:
    """Masks of which at least one drops all bits of any ``radius`` within a part; parts share ``bits`` bits evenly."""
    width = bits // parts
    labels = [1 + i % ((1 << radius + 1) - 1) for i in range(width)]
    kept = [sum(1 << i for i, m in enumerate(labels) if (m & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]
    return [k << part * width for part in range(parts) for k in kept]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(width: int, sets: bool):
    """(id, h, text) to (id, h, fp); with ``sets`` over distinct shingles, and with further bits, the digest of the set and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in texts(batch.column(2), 1 << 22):
                rows = []
                for text in held:
                    hashes = shingle_hashes(text, width)
                    if sets:
                        hashes = np.unique(hashes)
                        rows.append((_signed(fingerprint(hashes)), _signed(fingerprint(_mixed(hashes, 1))), _digest(hashes), len(hashes)))
                    else:
                        rows.append((_signed(fingerprint(hashes)),))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
                found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
                columns = [batch.column(c).slice(first, len(rows)) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*columns, *found], ["id", "h", "fp", "more", "node", "n"][: 2 + len(found)])

    return run


def _digest(shingles: np.ndarray) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(shingles.astype("<u8").tobytes())


def _sets(width: int):
    """(text) to (node, shingles): the sorted distinct hashes of a text's shingles, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, held in texts(batch.column(0), 1 << 22):
                found = {_digest(own): own.astype("<u8").tobytes() for own in (np.unique(shingle_hashes(t, width)) for t in held)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary())], ["node", "shingles"])

    return run


def similar(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``others`` have at least that Jaccard similarity to ``one``; all are sorted and distinct. Two empty sets have 1."""
    sizes = np.array([len(o) for o in others], dtype=np.int64)
    common = np.zeros(len(others), dtype=np.int64)
    if len(one) and sizes.any():
        joined = np.concatenate(others)
        at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
        common = np.bincount(np.repeat(np.arange(len(others)), sizes)[one[at] == joined], minlength=len(others))
    union = len(one) + sizes - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0) >= similarity


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the rows of two matrices of fingerprint words differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def similar_links(fps: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """A forest over the pairs of places within the radius whose sets are similar; only a link takes a member out of the search."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    out, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.flatnonzero(differing(fps[rest], fps[x]) <= radius)
            less, more = np.minimum(sizes[rest[near]], sizes[x]), np.maximum(sizes[rest[near]], sizes[x])
            near = near[np.where(more > 0, less / np.maximum(more, 1), 1.0) >= similarity]
            if len(near):
                near = near[similar(sets[x], [sets[k] for k in rest[near]], similarity)]
                found = rest[near].tolist()
                out += [(x, y) for y in found]
                queue += found
                rest = np.delete(rest, near)
    return out


def _similar_links(radius: int, similarity: float):
    """For mapInArrow over rows (g, i, j, fp, more, node, shingles) sorted by group g, i, j: (a, b), links between nodes."""

    def solved(held: list[tuple]) -> list[tuple[str, str]]:
        fps = np.array([row[:2] for row in held], dtype=np.int64).reshape(-1, 2).view(np.uint64)
        found = similar_links(fps, [np.frombuffer(row[3], "<u8") for row in held], radius, similarity)
        return [(held[x][2], held[y][2]) for x, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    out += solved(held)
                    key, held = row[:3], []
                held.append(row[3:])
            yield _named(out)
        yield _named(solved(held))

    return run


def _named(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["a", "b"])


def bucket_links(fps: np.ndarray, labels: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Places linked within a bucket of distinct fingerprints (rows of words): a forest over what is within the radius.

    Places of one label count as joined already and are not linked again.
    """
    out, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            own = labels[rest] == labels[x]
            met = own | (differing(fps[rest], fps[x]) <= radius)
            if met.any():
                out += [(x, y) for y in rest[met & ~own].tolist()]
                queue += rest[met].tolist()
                rest = rest[~met]
    return out


def links_of(fps: np.ndarray, labels: np.ndarray, bounds: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Places linked within the buckets that ``bounds`` cuts: those of small ones by comparing each row with the next, next but one, .."""
    sizes = np.diff(bounds)
    small = sizes <= SMALL
    ends = np.repeat(np.where(small, bounds[1:], 0), sizes)
    here, hits, step = np.arange(len(fps)), [], 0
    while len(here):
        step += 1
        here = here[ends[here] > here + step]
        near = here[(differing(fps[here], fps[here + step]) <= radius) & (labels[here] != labels[here + step])]
        hits.append(np.stack([near, near + step], axis=1))
    hits = np.concatenate(hits) if hits else np.zeros((0, 2), dtype=np.int64)
    bucket = np.searchsorted(bounds, hits[:, 0], side="right") - 1
    which, count = np.unique(bucket, return_counts=True)
    out = list(map(tuple, hits[np.isin(bucket, which[count == 1])].tolist()))
    for k in [*which[count > 1].tolist(), *np.flatnonzero(~small).tolist()]:
        begin = int(bounds[k])
        out += [(begin + x, begin + y) for x, y in bucket_links(fps[begin : bounds[k + 1]], labels[begin : bounds[k + 1]], radius)]
    return out


def _links(radius: int, keys: int, most: int | None):
    """For mapInArrow over rows (``keys`` bucket columns, label, fingerprint words) sorted by bucket: (a, b, t), links between labels.

    A bucket of more than ``most`` members is not searched; it comes out as (its key, null, its table).
    """
    most = most or 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if large is not None:  # the rest of a bucket that is named already
                other = (now[:, :keys] != large).any(axis=1)
                if not other.any():
                    continue
                now, large = now[other.argmax() :], None
            now = now if held is None else np.concatenate([held, now])
            bounds = np.flatnonzero(np.concatenate(([True], (now[1:, :keys] != now[:-1, :keys]).any(axis=1), [True])))
            whole, held, named = now[: bounds[-2]], now[bounds[-2] :], []
            if len(held) > most:
                named, large, held = [held[0, :keys]], held[0, :keys], None
            out = solved(whole, bounds[:-1], named)
            if out.num_rows:
                yield out
        if held is not None:
            yield solved(held, np.array([0, len(held)]), [])

    def solved(rows: np.ndarray, bounds: np.ndarray, named: list) -> pa.RecordBatch:
        sizes = np.diff(bounds)
        named = [*named, *(rows[k, :keys] for k in bounds[:-1][sizes > most].tolist())]
        rows, sizes = rows[np.repeat(sizes <= most, sizes)], sizes[sizes <= most]
        found = links_of(rows[:, keys + 1 :].view(np.uint64), rows[:, keys], np.concatenate(([0], np.cumsum(sizes))), radius)
        pairs = np.unique(np.sort(rows[:, keys][np.array(found, dtype=np.int64).reshape(-1, 2)], axis=1), axis=0)
        a = [*pairs[:, 0].tolist(), *(int(x[1]) for x in named)]
        b = [*pairs[:, 1].tolist(), *([None] * len(named))]
        t = [*([None] * len(pairs)), *(int(x[0]) for x in named)]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t, pa.int32())], ["a", "b", "t"])

    return run


def links(nodes: DataFrame, words: list[str], tables: list[tuple[int, int]], reach: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the labels of distinct fingerprints, joining what pairs that meet in a table and are within ``reach`` join.

    ``nodes`` has a column ``label`` and the columns ``words`` of the fingerprint; a table is the place of a word and a mask.
    """
    kinds = "a long, b long, t int"
    constant = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    word = F.element_at(F.array(*words), F.element_at(constant([w + 1 for w, _ in tables], "int"), F.col("t") + 1))
    key = word.bitwiseAND(F.element_at(constant([_signed(m) for _, m in tables], "long"), F.col("t") + 1))
    columns = ["label", *words]
    dealt = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(len(tables) - 1))).alias("t"), *columns)
    keyed = lambda df: df.select("t", key.alias("key"), *columns)  # noqa: E731  keys are computed again after the shuffle, which thus moves less
    found, _ = cut_narrow(keyed(dealt.repartition("t", key)).sortWithinPartitions("t", "key", *words).mapInArrow(_links(reach, 2, bucket), kinds).distinct())
    large = found.where("t IS NOT NULL").select("t", F.col("a").alias("key"))
    joined = found.where("t IS NULL").select("a", "b")
    if large.isEmpty():
        return joined
    # a large bucket: members are dealt into blocks of half a bucket, and every pair of blocks is a group of its own
    hot = keyed(dealt).join(large, ["t", "key"])
    sized = hot.join(cut(hot.groupBy("t", "key").count()), ["t", "key"])
    blocks = F.ceil(F.col("count") / (bucket / 2))
    own = F.pmod(F.xxhash64(*words), blocks)
    met = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))))
    split = sized.select("t", "key", met.alias("m"), *columns).select("t", "key", "m.i", "m.j", *columns)
    solved = split.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", *words).mapInArrow(_links(reach, 4, None), kinds)
    return joined.unionByName(solved.where("t IS NULL").select("a", "b")).distinct()


def near_components(nodes: DataFrame, words: list[str], radius: int, parts: int = 1, reach: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(node, root) for the first words of distinct fingerprints: what pairs that meet in a table and are within ``reach`` join.

    Parts are dealt evenly to the words, and each covers ``radius``. A few tables go first, and a node's least neighbour
    there is its label: nodes of one label are joined already, so the other tables hand on few links of a large group.
    """
    reach = radius if reach is None else reach
    tables = [(w, m) for w in range(len(words)) for m in masks(radius, parts // len(words))]
    first, others = tables[::EARLY], [t for k, t in enumerate(tables) if k % EARLY]
    nodes, _ = cut_narrow(nodes.select(F.col(words[0]).alias("label"), *words), weight=len(tables))
    early = links(nodes, words, first, reach, bucket)
    if others:
        both = early.select(F.col("a").alias("label"), F.col("b").alias("to")).unionByName(early.select(F.col("b").alias("label"), F.col("a").alias("to")))
        least = both.groupBy("label").agg(F.min("to").alias("to"))
        labelled = nodes.join(least, "label", "left").select(F.least("label", "to").alias("label"), *words)
        early = early.unionByName(links(labelled, words, others, reach, bucket))
    return components(early, "a", "b")


def similar_pairs(docs: DataFrame, nodes: DataFrame, width: int, radius: int, parts: int, reach: int, similarity: float, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between ``nodes`` (fp, more, node, h, n) within a group that ``links`` joins, within reach, and similar.

    Shingle sets are computed once more from ``docs`` (h, text), for one text of each node of a group of two or more, and
    each group is searched by reach and sets at once.
    """
    roots = near_components(nodes.select("fp", "more").distinct(), ["fp", "more"], radius, parts, reach, bucket)
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("g", F.coalesce("root", "fp"))
    placed, _ = cut_narrow(placed.select("g", "fp", "more", "node", "h", "n"))
    groups = placed.groupBy("g").agg(F.count("*").alias("of"), F.sum("n").alias("total")).where(F.col("of") > 1)
    blocks = F.greatest(F.ceil(F.col("of") / (bucket / 2)), F.ceil(F.col("total") * 8 / SET_BYTES))
    members, _ = cut_narrow(placed.join(groups.select("g", blocks.alias("blocks")), "g"))
    asked, (n,) = cut_narrow(members.select("h").distinct())
    few = n <= BROADCAST_ROWS
    sets = docs.join(F.broadcast(asked) if few else asked, "h", "left_semi").select("text").mapInArrow(_sets(width), "node string, shingles binary")
    sets = sets.groupBy("node").agg(F.min("shingles").alias("shingles"))  # equal digests have equal sets
    # members of a large group are dealt into blocks, and every pair of blocks is a group of its own
    own = F.pmod(F.xxhash64("fp", "node"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: (j != own) | (F.col("blocks") == 1))
    met = F.explode(F.transform(others, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))))
    dealt = members.join(sets, "node").select("g", "fp", "more", "node", "shingles", met.alias("m")).select("g", "m.i", "m.j", "fp", "more", "node", "shingles")
    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_similar_links(reach, similarity), "a string, b string")


def near_groups(docs: DataFrame, width: int = 4, radius: int = 4, parts: int = 1, reach: int | None = None, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, h (a hash of its text), fp, component (the smallest id reachable over links).

    Fingerprints of 64 bits link within the reach (the radius, if none is given). With a ``similarity`` they have 128 bits,
    and links also need that Jaccard similarity of their shingle sets.
    """
    text = F.col(text_col).cast("string")
    reach = radius if reach is None else reach
    held = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))
    tables = parts << radius + 1  # each fingerprint is dealt to all of them, so its rows stay in as many tasks as that asks for
    rows, _ = cut_narrow(held.mapInArrow(_fingerprints(width, similarity is not None), "id long, h long, fp long" + (", more long, node string, n long" if similarity is not None else "")), weight=tables)
    if similarity is None:
        rows = rows.withColumn("node", F.col("fp"))
        roots = near_components(rows.select("fp").distinct(), ["fp"], radius, parts, reach)
    else:
        nodes, _ = cut_narrow(rows.groupBy("fp", "more", "node").agg(F.min("h").alias("h"), F.min("n").alias("n")), weight=tables)
        roots = components(similar_pairs(held, nodes, width, radius, parts, reach, similarity), "a", "b")
    named = rows.groupBy("node").agg(F.min("id").alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return rows.select("id", "h", "fp", "node").join(named.join(least, "root").select("node", "component"), "node").select("id", "h", "fp", "component")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_groups(docs, width=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def near_dedup(docs: DataFrame, width: int = 5, radius: int = 4, parts: int = 4, reach: int = REACH, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, the one with the smallest id, of each group of near-duplicates. Null ids stay.

    Rows leave by id and text, so that an id which repeats with another text keeps the rows that have no duplicate.
    """
    found = near_groups(docs, width, radius, parts, reach, similarity, id_col, text_col)
    gone, _ = cut_narrow(found.where(F.col("id") != F.col("component")).select("id", "h").distinct())
    return without(docs, gone, {"id": F.col(id_col).cast("long"), "h": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
