"""Exact n-gram Jaccard join of documents, and the groups that its links form.

Documents with the same set of shingles are one node. Two sets can only reach the threshold if their prefixes, the rarest part of each in one global
order, share a shingle. Sets that share one meet under the smallest of them (the lead); the most promising lead of each set is checked first, and what
those links already hold together needs no further pairs. Sets under leads that still hold several groups are dealt into tiles by lead and band of size: a
band is as wide as the threshold's ratio, so sets that may link are in one band or in two that follow each other. In a tile, sizes and bitmap signatures
bound the overlap from above, and the pairs that are left are settled by intersecting sorted arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, distinct_name, forget, large, map_arrow, staged
from .graph import components
from .words import U, Chunk, chunks, longs, mix

#: Counters of the sketch that orders shingles from rare to frequent. Its size is fixed; it only steers how many candidates there are.
SKETCH = 1 << 17
#: Bits of the smallest signature. A set of n shingles has the next power of two that is at least n, so signatures bound overlaps alike at every size.
LEAST_BITS = 256
#: Bytes of signatures that are compared at a time.
COMPARED = 1 << 21
#: Members of a tile in one block, and of a lead in one group; and their shingles, of 8 bytes each.
TILE, TILE_SHINGLES = 512, 1 << 21
#: Sets of one batch that share a prefix shingle from which on the shingle is hot: its sets then don't meet in one task.
HOT, SALTS = 16, 1024
#: Sets that a task remembers as sent already; copies of sets that it forgot are dropped after the shuffle.
SEEN = 1 << 19
_DOC, _HASH = 52, (1 << 52) - 1
#: Bits of a shingle in a key.
_SHINGLE = 48


def shingles(c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document of a chunk, sorted by both. Hashes have 52 bits."""
    doc, _, h = c.grams(n)
    short = np.flatnonzero((c.count > 0) & (c.count < n))
    doc, h = np.concatenate([doc, short]), np.concatenate([h, c.span(c.first[short], c.first[short + 1])])
    key = np.unique(doc.astype(U) << U(_DOC) | h >> U(64 - _DOC))
    return (key >> U(_DOC)).astype(np.int64), key & U(_HASH)


def _bounds(doc: np.ndarray, docs: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(docs + 1))


def signatures(doc: np.ndarray, h: np.ndarray, size: np.ndarray, density: int = 1) -> list[bytes]:
    """Parity bitmaps of at least `density` bits for each shingle: bit i says whether an odd number of the set's shingles have i as their lowest bits. Folding the halves of one by XOR gives that of half the size."""
    bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(density * size, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits)])
    flat = first[doc] + (h & (bits[doc] - 1).astype(U)).astype(np.int64)
    packed = np.packbits(np.bincount(flat, minlength=first[-1]).astype(np.uint8) & 1).tobytes()
    return [packed[s:e] for s, e in zip(first // 8, first[1:] // 8, strict=False)]


class Signatures:
    """Those of some sets, for comparing pairs."""

    def __init__(self, bits: list[bytes]):
        self.level = np.array([len(b).bit_length() for b in bits], np.int64)
        self.bits, self.made = bits, {}

    def _at(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of each set, matrix) of the sets of this level, and of those of the next, folded."""
        if level not in self.made:
            own, next_ = np.flatnonzero(self.level == level), np.flatnonzero(self.level == level + 1)
            words = (1 << (level - 1)) // 8
            rows = [np.frombuffer(b"".join(self.bits[i] for i in own), np.uint64).reshape(len(own), words)]
            if len(next_):
                wide = np.frombuffer(b"".join(self.bits[i] for i in next_), np.uint64).reshape(len(next_), 2 * words)
                rows.append(wide[:, :words] ^ wide[:, words:])
            place = np.full(len(self.bits), -1)
            place[np.concatenate([own, next_])] = np.arange(len(own) + len(next_))
            self.made[level] = place, np.concatenate(rows)
        return self.made[level]

    def differences(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """At least so many shingles are in one of the sets p and q only. 0 where sizes are too far apart for a comparison."""
        out = np.zeros(len(p), np.int64)
        low = np.minimum(self.level[p], self.level[q])
        near = np.abs(self.level[p] - self.level[q]) <= 1
        for level in np.unique(low[near]):
            at = np.flatnonzero(near & (low == level))
            place, rows = self._at(int(level))
            step = max(1, COMPARED // (rows.shape[1] * 8))
            for s in range(0, len(at), step):
                i = at[s : s + step]
                out[i] = np.bitwise_count(rows[place[p[i]]] ^ rows[place[q[i]]]).sum(axis=1, dtype=np.int64)
        return out


def may_reach(n: np.ndarray, m: np.ndarray, differ: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets of n and m shingles, of which at least `differ` are in one only, can reach the threshold."""
    most = np.minimum((n + m - differ) // 2, np.minimum(n, m))
    return 100 * most >= threshold * (n + m - most)


def described(docs: DataFrame, n: int) -> DataFrame:
    """One row per document (kind 0): doc_id, row (hash of the row), n, set (hash of the set), bits (parity bitmap). Besides, by task, what the sketch counts (kind 1): set is the counter, n the count."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        names = ["kind", "doc_id", "row", "n", "set", "bits"]
        arrow_id = None
        for b in batches:
            arrow_id = b.schema.field(0).type
            for at, c in chunks(b.column(1), lower=True):
                m = len(c.count)
                doc, h = shingles(c, n)
                first = _bounds(doc, m)
                size = np.diff(first)
                mixed = np.concatenate([np.zeros(1, U), np.cumsum(mix(h + U(1)))])
                ident = mix(mixed[first[1:]] - mixed[first[:-1]] + size.astype(U))
                sketch += np.bincount((h & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                bits = signatures(doc, h, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), b.column(0).slice(at, m), b.column(2).slice(at, m), longs(size), longs(ident), pa.array(bits, pa.binary())], names=names)
        at = np.flatnonzero(sketch)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.nulls(len(at), arrow_id), pa.nulls(len(at), pa.int64()), longs(sketch[at]), longs(at), pa.nulls(len(at), pa.binary())], names=names)

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    return map_arrow(rows, run, f"kind int, doc_id {id_type}, row long, n long, `set` long, bits binary")


def levels(counts: DataFrame) -> np.ndarray:
    """How frequent the shingles of each counter are: 0 up to twice the mean, then by powers of two, 15 at most."""
    got = counts.groupBy("set").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(SKETCH)
    total[got["set"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return np.clip(np.floor(np.log2(np.maximum(total, 1) / (total.mean() + 1))), 0, 15).astype(np.uint8)


def postings(docs: DataFrame, n: int, threshold: int, level: np.ndarray) -> DataFrame:
    """(key, set, n) for the shingles in each set's prefix, once per set and batch.

    A shingle is hot in a batch if many sets have it there. Its sets then get a salt, so that no task has to read them all, and the smallest of them has a further row without salt
    that tells so: it goes where the shingle's sets from other batches are. key holds salt, shingle, and 0 for such a row, else 1, from the upper bits down.
    """
    order, least = docs.sparkSession.sparkContext.broadcast(level), HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            parts = []
            for _, c in chunks(b.column(0), lower=True):
                m = len(c.count)
                doc, h = shingles(c, n)
                first = _bounds(doc, m)
                size = np.diff(first)
                mixed = np.concatenate([np.zeros(1, U), np.cumsum(mix(h + U(1)))])
                ident = mix(mixed[first[1:]] - mixed[first[:-1]] + size.astype(U))
                new = np.zeros(m, bool)
                if len(seen) > SEEN:
                    seen.clear()
                for i in np.flatnonzero(size):
                    if (x := int(ident[i])) not in seen:
                        seen.add(x)
                        new[i] = True
                prefix = np.where(new, size - -(-threshold * size // 100) + 1, 0)
                # Rarest level first, then by hash; 4 bits of the hash make room for the level.
                key = doc.astype(U) << U(_DOC) | order.value[(h & U(SKETCH - 1)).astype(np.int64)].astype(U) << U(_SHINGLE) | h >> U(4)
                key.sort()
                at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(prefix)[:-1]]), prefix) + np.arange(prefix.sum())
                parts.append((key[at] & U((1 << _SHINGLE) - 1), np.repeat(ident, prefix), np.repeat(size, prefix)))
            if not parts:
                continue
            key, ident, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.lexsort((ident, size, key))
            key, ident, size = key[by], ident[by], size[by]
            opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            many = np.diff(np.r_[opens, len(key)])
            hot = np.repeat(many >= least, many)
            salt = np.where(hot, 1 + (mix(ident) % U(SALTS)).astype(np.int64), 0)
            lead = opens[many >= least]
            packed = np.r_[salt.astype(U) << U(_SHINGLE + 1) | key << U(1) | U(1), key[lead] << U(1)]
            yield pa.RecordBatch.from_arrays([longs(packed), longs(np.r_[ident, ident[lead]]), longs(np.r_[size, size[lead]])], names=["key", "set", "n"])

    return map_arrow(docs.select("text"), run, "key long, `set` long, n long")


def tiles(rows: DataFrame) -> DataFrame:
    """(key, a, b, na, nb): a is the smallest set that has a key, b each other one; for the sets b of hot keys, a is null and key tells which.

    Sorted input is read as a stream, so a key may have any number of sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead, lead_n, seen_set, lead_hot = None, 0, 0, 0, False
        for b in batches:
            packed, ident, n = (b.column(i).to_numpy() for i in range(3))
            if not len(packed):
                continue
            key, tells = packed >> 1, packed & 1 == 0
            opens = np.empty(len(key), bool)
            opens[0] = last is None or key[0] != last
            opens[1:] = key[1:] != key[:-1]
            at = np.maximum.accumulate(np.where(opens, np.arange(len(key)), -1))
            a = np.where(at >= 0, ident[at], lead)
            na = np.where(at >= 0, n[at], lead_n)
            # Rows that tell that a key is hot come first.
            hot = np.where(at >= 0, tells[at], lead_hot) | (key >> _SHINGLE > 0)
            before = np.concatenate([[seen_set if not opens[0] else ~ident[0]], ident[:-1]])
            again = ~opens & (ident == before)
            keep = np.where(hot, ~again | tells, ~opens & (ident != a) & ~again)
            last, lead, lead_n, seen_set, lead_hot = key[-1], a[-1], na[-1], ident[-1], hot[-1]
            if keep.any():
                key, a, ident, na, n, hot = (x[keep] for x in (key, a, ident, na, n, hot))
                yield pa.RecordBatch.from_arrays([pa.array(key & ((1 << _SHINGLE) - 1), mask=~hot), pa.array(a, mask=hot), pa.array(ident), pa.array(na, mask=hot), pa.array(n)], names=["key", "a", "b", "na", "nb"])

    dealt = rows.select("key", "set", "n").repartition(F.shiftright("key", 1)).sortWithinPartitions("key", "n", "set")
    return map_arrow(dealt, run, "key long, a long, b long, na long, nb long")


def led(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(a, b, na, nb, votes): how many prefix shingles bring the set b under the lead a. The lead of a hot key is the smallest of its sets, found by a minimum that is combined before the shuffle."""
    found = staged(spark, found, "tiles")
    hot = found.where("a IS NULL").select("key", "b", "nb")
    stars = found.where("a IS NOT NULL").select("a", "b", "na", "nb")
    leads = staged(spark, hot.groupBy("key").agg(F.min(F.struct("nb", "b")).alias("l")).select("key", F.col("l.b").alias("a"), F.col("l.nb").alias("na")), "hot")
    more = hot.join(leads if large(leads) else F.broadcast(leads), "key").where("a <> b").select("a", "b", "na", "nb")
    stars = staged(spark, stars.unionByName(more).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("votes")), "stars")
    forget(spark, found, leads)
    return stars


def overlaps(spark: SparkSession, docs: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, threshold: int) -> DataFrame:
    """Those of pairs (a, b) whose sets reach the threshold, by intersecting the sorted arrays of whole texts.

    A lead's text is sent once for every TILE of its partners, a partner's once for every pair.
    """
    pairs = pairs.select("a", "b")
    groups = pairs.groupBy("a").agg(F.count("*").alias("c")).withColumn("salts", F.ceil(F.col("c") / TILE).cast("int"))
    leads = groups.select(F.col("a").alias("set"), F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    members = pairs.join(groups, "a").select(F.col("b").alias("set"), F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    roles = staged(spark, leads.unionByName(members).join(sets.select("set", "row"), "set"), "roles")
    if roles.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        roles = F.broadcast(roles)
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("row")).join(roles, "row").select("lead", "salt", "role", "set", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead, done = None, None, None
        for b in batches:
            heads = [b.column(i).to_numpy() for i in range(4)]
            found = []
            for at, c in chunks(b.column(4), lower=True):
                doc, h = shingles(c, n)
                first = _bounds(doc, len(c.count))
                for i in range(len(c.count)):
                    a, salt, role, ident = (int(x[at + i]) for x in heads)
                    mine = h[first[i] : first[i + 1]]
                    if role == 0:
                        if group != (a, salt):
                            group, lead, done = (a, salt), mine.copy(), None
                    elif ident != done:  # equal rows come one after the other
                        done = ident
                        place = np.searchsorted(lead, mine)
                        place[place == len(lead)] = 0
                        both = int((lead[place] == mine).sum())
                        if 100 * both >= threshold * (len(lead) + len(mine) - both):
                            found.append((a, ident))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = texts.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "role", "set")
    return map_arrow(dealt, run, "a long, b long")


def rivals(spark: SparkSession, stars: DataFrame, groups: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, band, x, y, set, n, root, block): the sets of each open tile that may reach the threshold, by sizes and bitmaps, with one of another group there.

    A lead is open while its sets belong to different groups. Its tiles are bands of sizes: a tile holds the sets of its band and those of the band below. One with many sets, or
    large ones, is cut into blocks, and x, y are the two that meet.
    """
    few = (lambda df: df) if large(groups) else F.broadcast
    of = few(groups.select(F.col("node").alias("a"), F.col("root").alias("ra")))
    to = few(groups.select(F.col("node").alias("b"), F.col("root").alias("rb")))
    open_ = stars.join(of, "a", "left").join(to, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    leads = staged(spark, open_.groupBy("a").agg(F.count("*").alias("c")).select("a"), "open")
    few = (lambda df: df) if large(leads) else F.broadcast
    members = stars.join(few(leads), "a", "left_semi").select("a", "b").union(leads.select("a", F.col("a").alias("b")))
    info = sets.select(F.col("set").alias("b"), "n", "bits")
    # Sets of one band or of neighbouring ones only can be within the ratio; the bands are a little wider, so that rounding loses none.
    own = F.floor(F.log(F.col("n")) / (math.log(100 / threshold) * (1 + 1e-6))).cast("int") if threshold < 100 else F.col("n").cast("int")
    members = members.join(info, "b").withColumn("own", own).join(to, "b", "left").select("a", "b", "n", "bits", "own", F.coalesce("rb", "b").alias("root"), F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("band"))
    members = staged(spark, members, "members")
    cut = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    count = members.groupBy("a", "band").agg(cut.alias("blocks"), F.max("own").alias("top"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("top = band AND r0 <> r1").select("a", "band", "blocks")
    members = members.join(count if large(count) else F.broadcast(count), ["a", "band"]).withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.select("a", "band", "b", "n", "bits", "own", "root", "block", other).select("a", "band", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "b", "n", "bits", "own", "root", "block")

    def settle(tile, ident, n, own, root, block, bits) -> Iterator[pa.RecordBatch]:
        """One tile: its first block against its second, or a block against itself. A pair of the band below has a tile of its own."""
        signs, needed = Signatures(bits), np.zeros(len(ident), bool)
        left = block == block.min()
        right = ~left if not left.all() else left
        li, ri = np.flatnonzero(left), np.flatnonzero(right)
        for s in range(0, len(li), 64):
            i = li[s : s + 64]
            big, little = np.maximum(n[i, None], n[None, ri]), np.minimum(n[i, None], n[None, ri])
            may = (100 * little >= threshold * big) & (np.maximum(own[i, None], own[None, ri]) == tile[1]) & (root[i, None] != root[None, ri]) & (ident[i, None] < ident[None, ri] if right is left else True)
            p, q = np.nonzero(may)
            p, q = i[p], ri[q]
            keep = may_reach(n[p], n[q], signs.differences(p, q), threshold)
            p, q = p[keep], q[keep]
            needed[p] = needed[q] = True
        at = np.flatnonzero(needed)
        if len(at):
            where = [pa.array(np.full(len(at), v, t)) for v, t in zip(tile, (np.int64, np.int32, np.int32, np.int32), strict=True)]
            yield pa.RecordBatch.from_arrays([*where, pa.array(ident[at]), pa.array(n[at]), pa.array(own[at]), pa.array(root[at]), pa.array(block[at])], names=["a", "band", "x", "y", "set", "n", "own", "root", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, bits = None, [], []
        for b in batches:
            head = np.stack([b.column(k).to_numpy() for k in range(4)], axis=1)
            cols = [b.column(k).to_numpy() for k in (4, 5, 6, 7, 8)]
            signs = b.column(9).to_pylist()
            edges = [0, *(np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1), len(head)]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                if tile != tuple(head[s]):
                    if held:
                        yield from settle(tile, *(np.concatenate(x) for x in zip(*held, strict=True)), bits)
                    tile, held, bits = tuple(head[s]), [], []
                held.append([c[s:e] for c in cols])
                bits += signs[s:e]
        if held:
            yield from settle(tile, *(np.concatenate(x) for x in zip(*held, strict=True)), bits)

    sorted_ = dealt.select("a", "band", "x", "y", "b", "n", "own", "root", "block", "bits").repartition("a", "band", "x", "y").sortWithinPartitions("a", "band", "x", "y", "b")
    return map_arrow(sorted_, run, "a long, band int, x int, y int, `set` long, n long, own int, root long, block int")


def tile_links(spark: SparkSession, docs: DataFrame, sets: DataFrame, members: DataFrame, n: int, threshold: int) -> DataFrame:
    """(a, b): links that join the groups which meet in the tiles of members, by intersecting sorted arrays of whole texts.

    A text is sent once for each of its tiles, not for each pair; pairs that are already in one group are passed over, so a tile gives fewer links than it has members.
    """
    roles = members.join(sets.select("set", "row"), "set")
    roles = staged(spark, roles, "roles")
    if roles.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        roles = F.broadcast(roles)
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("row")).join(roles, "row").select("a", "band", "x", "y", "set", "own", "root", "block", "text")

    def settle(tile, ident, own, root, block, arrays) -> Iterator[pa.RecordBatch]:
        group = {r: r for r in root}

        def find(r: int) -> int:
            while group[r] != r:
                group[r] = group[group[r]]
                r = group[r]
            return r

        size = np.array([len(h) for h in arrays], np.int64)
        signs = Signatures(signatures(np.repeat(np.arange(len(arrays)), size), np.concatenate(arrays), size, 8))  # denser than those that are shuffled
        first = min(block)
        left = [i for i, b in enumerate(block) if b == first]
        apart = len(left) < len(block)
        right = np.array([i for i, b in enumerate(block) if b != first] if apart else left)
        found, own = [], np.array(own)
        for i in left:
            q = right if apart else right[right > i]
            q = q[np.maximum(own[q], own[i]) == tile[1]]
            q = q[100 * np.minimum(size[q], size[i]) >= threshold * np.maximum(size[q], size[i])]
            q = q[np.array([root[j] != root[i] for j in q], bool)] if len(q) else q
            differ = signs.differences(np.full(len(q), i), q)
            fine = may_reach(np.full(len(q), size[i]), size[q], differ, threshold)
            for j in q[fine][np.argsort(differ[fine], kind="stable")]:
                p, r = find(root[i]), find(root[j])
                if p == r:
                    continue
                place = np.searchsorted(arrays[i], arrays[j])
                place[place == size[i]] = 0
                both = int((arrays[i][place] == arrays[j]).sum())
                if 100 * both >= threshold * (size[i] + size[j] - both):
                    group[max(p, r)] = min(p, r)
                    found.append((ident[i], ident[j]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, ([], [], [], [], [])
        for b in batches:
            heads = [b.column(k).to_pylist() for k in range(8)]
            for at, c in chunks(b.column(8), lower=True):
                doc, h = shingles(c, n)
                first = _bounds(doc, len(c.count))
                for i in range(len(c.count)):
                    *here, ident, own, root, block = (v[at + i] for v in heads)
                    if tile != here:
                        if held[0]:
                            yield from settle(tile, *held)
                        tile, held = here, ([], [], [], [], [])
                    if not held[0] or held[0][-1] != ident:  # equal rows come one after the other
                        for v, value in zip(held, (ident, own, root, block, h[first[i] : first[i + 1]].copy()), strict=True):
                            v.append(value)
        if held[0]:
            yield from settle(tile, *held)

    dealt = texts.repartition("a", "band", "x", "y").sortWithinPartitions("a", "band", "x", "y", "set")
    return map_arrow(dealt, run, "a long, b long")


def promising(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of pairs (a, b) that sizes and signatures don't rule out."""
    info = sets.select("set", "n", "bits")
    both = pairs.join(info.toDF("a", "na", "abits"), "a").join(info.toDF("b", "nb", "bbits"), "b").select("a", "b", "na", "nb", "abits", "bbits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            for s in range(0, m, 2000):
                part = b.slice(s, 2000)
                k = part.num_rows
                signs = Signatures([*part.column(4).to_pylist(), *part.column(5).to_pylist()])
                keep = may_reach(part.column(2).to_numpy(), part.column(3).to_numpy(), signs.differences(np.arange(k), np.arange(k, 2 * k)), threshold)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return map_arrow(both, run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int = 5, threshold: int = 75) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, copies, root): every row of docs (doc_id, text) with the smallest doc_id that links lead to from it.

    A set holds the distinct runs of n words (bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased) of the whole text; a text of fewer words is one
    shingle; a text that is null or has no word has an empty set and is linked with nothing. Sets link when 100 * intersection >= threshold * union.
    No link between different texts is lost. Rows that share a doc_id are told apart by their text; a null doc_id takes part, and a component
    of such rows alone has a null id. root names the component. Other columns are ignored; an empty table gives no row. copies: rows with the same set. Sets are named by
    64-bit hashes and shingles compared by 52 bits of theirs.
    """
    told = staged(spark, described(docs, n), "described")
    order = levels(told.where("kind = 1"))
    rows = told.where("kind = 0").drop("kind")
    sets = rows.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    sets = staged(spark, sets, "sets")
    stars = led(spark, tiles(postings(docs, n, threshold, order)))
    best = stars.where(100 * F.col("na") >= threshold * F.col("nb")).groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a"))
    best = staged(spark, promising(best.select("a", "b"), sets, threshold), "leads")
    links = staged(spark, overlaps(spark, docs, sets, best, n, threshold), "links")
    groups = staged(spark, components(spark, links), "groups")
    more = staged(spark, rivals(spark, stars, groups, sets, threshold), "rivals")
    if not more.isEmpty():
        forget(spark, groups)
        further = staged(spark, tile_links(spark, docs, sets, more, n, threshold), "links")
        groups = staged(spark, components(spark, links.unionByName(further)), "groups")
        forget(spark, further)
    forget(spark, stars, best, links, more)
    named = sets.select("set", "doc_id", "copies").join(groups, sets["set"] == groups["node"], "left").select("set", "doc_id", "copies", F.coalesce("root", "set").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "root").select("set", "root", "component_id", "copies")
    out = rows.join(named, "set", "left")
    out = out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"), "root")
    out = staged(spark, out, "near")
    forget(spark, told, sets, groups)
    return out


def one_of_each(spark: SparkSession, docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id (null last; of several such rows, the one with the smallest hash). Rows without words all stay."""
    found = near_duplicates(spark, docs, **parameters)
    firsts = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("k"), F.count("*").alias("rows"))
    times = found.where("n_shingles > 0").groupBy("row").agg(F.count("*").alias("times"))
    firsts = firsts.select(F.col("k.row").alias("row")).join(times, "row")
    keep = staged(spark, firsts.unionByName(found.where("n_shingles = 0").select("row", F.lit(1).cast("long").alias("times")).distinct()), "keep")
    forget(spark, found)
    at, row, times = (distinct_name(docs, x) for x in ("_at", "_row", "_times"))
    hint = keep.toDF(row, times)
    if keep.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hint = F.broadcast(hint)
    kept = docs.withColumn(at, F.xxhash64("doc_id", "text")).join(hint, F.col(at) == F.col(row))
    if keep.where("times > 1").isEmpty():
        return kept.select(*docs.columns)
    once = kept.where(F.col(times) > 1).dropDuplicates([at])  # the same row, again and again
    return kept.where(F.col(times) == 1).select(*docs.columns).unionByName(once.select(*docs.columns))
