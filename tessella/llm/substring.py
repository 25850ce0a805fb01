"""Removal of repeated word sequences through a compacted De Bruijn graph.

An edge of the graph is a window of words; it leads from its first words to its last ones, so an edge's neighbours are the windows one word before and after
it. Only windows that start more than once are edges. The steps:

1. Each window has an anchor, that of its k-mers with the smallest hash. Equal windows have equal anchors at equal places, so windows are dealt by anchor,
   as runs of consecutive windows that share one. An anchor that occurs once has no repeated window. If all runs of an anchor are equal, the run is one
   edge already; otherwise its windows are counted one by one.
2. Every edge learns which edges come before and after it. One with several neighbours on a side, or with a text's repeat ending there, is a branch.
3. Joined with the branches, the edges of each text are compacted to nonbranching paths. Wherever an edge of a path occurs, the whole path does.
4. The words at the source coordinates of each path are compared by a digest of 128 bits. Where they aren't the same, edges had the same hash by chance;
   then the windows of those paths are counted by their words.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct_name, forget, map_arrow, staged
from .words import U, Chunk, chunks, longs, mix

#: Bits of the filters that go to all tasks: 2**25 bits are 4 MB, at every size of input. They only save rows; joins decide.
FILTER_BITS = 25
_LOW = (1 << 32) - 1


def runs(c: Chunk, window: int, k: int, hash_bits: int = 64) -> tuple[np.ndarray, ...]:
    """(document, first word in the chunk, windows, anchor hash, run hash) of each run of windows that share an anchor."""
    drop = U(64 - hash_bits)
    doc, word, h = c.grams(k)
    h = h >> drop
    span = window - k + 1  # k-mers in a window
    counts = np.maximum(c.count - window + 1, 0)
    total = int(counts.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U))
    owner = np.repeat(np.arange(len(counts)), counts)
    kmers = np.maximum(c.count - k + 1, 0)
    # Index, among all k-mers of the chunk, of the first k-mer of each window.
    at = np.arange(total) + np.repeat((np.cumsum(kmers) - kmers) - (np.cumsum(counts) - counts), counts)
    # Leftmost smallest k-mer of each window, by doubling. Places near a document's end run into the next one, but no window starts there.
    best = np.arange(len(h))
    length = 1
    while length * 2 <= span:
        other = best[np.minimum(np.arange(len(h)) + length, len(h) - 1)]
        best = np.where(h[other] < h[best], other, best)
        length *= 2
    if length < span:
        other = best[np.minimum(np.arange(len(h)) + span - length, len(h) - 1)]
        best = np.where(h[other] < h[best], other, best)
    anchor = best[at]
    opens = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    n = np.diff(np.r_[opens, total])
    start = word[at[opens]]
    offset = word[anchor[opens]] - start
    return owner[opens], start, n, h[anchor[opens]], mix(c.span(start, start + n + window - 1) + offset.astype(U)) >> drop


def _bit(h: np.ndarray) -> np.ndarray:
    return mix(h.view(U) if h.dtype != U else h) >> U(64 - FILTER_BITS)


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """The bits of a column of longs. The driver gets at most 2**FILTER_BITS / 64 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = _bit(b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([longs(bit >> U(6)), longs(U(1) << (bit & U(63)))], names=["word", "bits"])

    got = map_arrow(df.select(column), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), U)
    bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(U)
    return bits


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = _bit(h)
    return (bits[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == U(1)


def _lists(n: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists of n[0], n[1], ... of the values."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), values)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(first place of each list and one past the last, values)."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.values.slice(offsets[0], offsets[-1] - offsets[0])


def edges(spark: SparkSession, docs: DataFrame, window: int, k: int, hash_bits: int) -> DataFrame:
    """(row, start, n, edge): the n windows from word start of that row of docs (text, row), which occur more than once or have a hash that does."""
    drop = U(64 - hash_bits)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, c in chunks(b.column(0)):
                _, _, n, anchor, run = runs(c, window, k, hash_bits)
                # Equal runs of a chunk go on as one row with their number.
                order = np.lexsort((n, run, anchor))
                n, anchor, run = n[order], anchor[order], run[order]
                first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1]) | (n[1:] != n[:-1])]) if len(run) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([longs(anchor[first]), longs(run[first]), pa.array(n[first].astype(np.int32)), longs(np.diff(np.r_[first, len(run)]))], names=["anchor", "run", "n", "times"])

    found = map_arrow(docs.select("text"), anchors, "anchor long, run long, n int, times long")
    repeated = found.groupBy("anchor").agg(F.sum("times").alias("times"), F.min("run").alias("r0"), F.max("run").alias("r1"), F.min("n").alias("n0"), F.max("n").alias("n1")).where("times > 1")
    repeated = staged(spark, repeated.select("anchor", F.expr("r0 <> r1 OR n0 <> n1").alias("branches")), "anchors")
    again = spark.sparkContext.broadcast(bit_filter(repeated, "anchor"))
    branching = spark.sparkContext.broadcast(bit_filter(repeated.where("branches"), "anchor"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs whose anchor may occur again; with the hashes of their windows where runs may differ."""
        for b in batches:
            row = b.column(1).to_numpy()
            for at, c in chunks(b.column(0)):
                doc, start, n, anchor, _ = runs(c, window, k, hash_bits)
                keep = _in(again.value, anchor)
                doc, start, n, anchor = (x[keep] for x in (doc, start, n, anchor))
                m = np.where(_in(branching.value, anchor), n, 0)
                first = np.repeat(start - (np.cumsum(m) - m), m) + np.arange(m.sum())
                windows = _lists(m, longs(c.span(first, first + window) >> drop))
                yield pa.RecordBatch.from_arrays([longs(anchor), pa.array(row[at + doc]), pa.array((start - c.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), windows], names=["anchor", "row", "start", "n", "windows"])

    runs_of = map_arrow(docs.select("text", "row"), records, "anchor long, row long, start int, n int, windows array<long>").join(repeated, "anchor")
    runs_of = staged(spark, runs_of.select("row", "start", "n", "branches", F.when(~F.col("branches"), F.col("anchor")).alias("edge"), F.when(F.col("branches"), F.col("windows")).alias("windows")), "runs")
    again.destroy()
    branching.destroy()
    whole = runs_of.where("not branches").select("row", "start", "n", "edge")
    single = runs_of.where("branches").select("row", "start", F.posexplode("windows").alias("i", "edge")).select("row", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("n"), "edge")
    # A table of its own, so that the join can split a window that is very common.
    more = staged(spark, single.groupBy("edge").agg(F.count("*").alias("c")).where("c > 1").select("edge"), "windows")
    return whole.unionByName(single.join(more, "edge", "left_semi").select("row", "start", "n", "edge"))


def by_row(found: DataFrame) -> DataFrame:
    """(row, start, n, edge), the latter three as arrays in the order of start; a row is a text, so the arrays are no longer than it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64)]

        def packed(cols: list[np.ndarray]) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            n = np.diff(np.r_[first, len(cols[0])])
            return pa.RecordBatch.from_arrays([pa.array(cols[0][first]), *(_lists(n, pa.array(c)) for c in cols[1:])], names=["row", "start", "n", "edge"])

        for b in batches:
            kept = [np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate(kept)]
            if len(kept[0]) and kept[0][0] != kept[0][-1]:
                last = int(np.searchsorted(kept[0], kept[0][-1]))  # rows come sorted; the last may go on in the next batch
                yield packed([x[:last] for x in kept])
                kept = [x[last:] for x in kept]
        if len(kept[0]):
            yield packed(kept)

    return map_arrow(found.repartition("row").sortWithinPartitions("row", "start"), run, "row long, start array<int>, n array<int>, edge array<long>")


def _neighbours(start: pa.ListArray, n: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list offsets, starts, numbers of windows, whether the edge follows right after the one before it)."""
    at, s = _flat(start)
    s, m = s.to_numpy().astype(np.int64), _flat(n)[1].to_numpy().astype(np.int64)
    follows = np.zeros(len(s), bool)
    follows[1:] = s[1:] == s[:-1] + m[:-1]
    follows[at[:-1][at[:-1] < len(s)]] = False
    return at, s, m, follows


def paths(spark: SparkSession, texts: DataFrame, window: int) -> DataFrame:
    """(row, claims): the nonbranching paths along the edges of each text, as structs of span (first word << 32 | number of words) and path, which names the edges on it."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, m, follows = _neighbours(b.column(0), b.column(1))
            edge = _flat(b.column(2))[1].to_numpy()
            # Edges with one hash but different lengths are different neighbours.
            named = mix(edge.view(U) + mix(m.astype(U)))
            before, after = np.zeros(len(edge), U), np.zeros(len(edge), U)
            before[1:], after[:-1] = named[:-1], named[1:]
            gone = np.r_[~follows[1:], np.ones(min(1, len(edge)), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(edge), pa.array(before.view(np.int64), mask=~follows), pa.array(after.view(np.int64), mask=gone)], names=["edge", "before", "after"])

    def branches(side: str) -> Column:
        """A side has several neighbours, or one and an end."""
        return (F.min(side) != F.max(side)) | (F.min(side).isNotNull() & (F.count(side) < F.count("*")))

    degrees = map_arrow(texts.select("start", "n", "edge"), sides, "edge long, before long, after long").groupBy("edge").agg(F.coalesce(branches("before"), F.lit(False)).alias("before"), F.coalesce(branches("after"), F.lit(False)).alias("after"))
    nodes = staged(spark, degrees.where("before or after"), "branches")
    known = spark.sparkContext.broadcast(bit_filter(nodes, "edge"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each edge of a text that may branch, once, however often it comes."""
        for b in batches:
            at, edge = _flat(b.column(1))
            row, edge = np.repeat(b.column(0).to_numpy(), np.diff(at)), edge.to_numpy()
            keep = _in(known.value, edge)
            row, edge = row[keep], edge[keep]
            order = np.lexsort((edge, row))
            row, edge = row[order], edge[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (edge[1:] != edge[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(edge[first])], names=["row", "edge"])

    met = map_arrow(texts.select("row", "edge"), places, "row long, edge long").join(nodes, "edge")
    side = (F.col("before").cast("int") * 2 + F.col("after").cast("int")).alias("side")
    marks = met.groupBy("row").agg(F.collect_list(F.struct("edge", side)).alias("marks"))
    joined = texts.join(marks, "row", "left").select("row", "start", "n", "edge", F.coalesce("marks", F.expr("cast(array() as array<struct<edge:bigint,side:int>>)")).alias("marks"))

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, s, m, follows = _neighbours(b.column(1), b.column(2))
            edge = _flat(b.column(3))[1].to_numpy().view(U)
            if not len(edge):
                continue
            marked, mark, side = _read(b.column(4))
            # A text's edges are looked up among its marks, by text and edge.
            kinds = np.unique(edge)
            key = np.repeat(np.arange(b.num_rows), np.diff(at)) * len(kinds) + np.searchsorted(kinds, edge)
            known_key = np.repeat(np.arange(b.num_rows), np.diff(marked)) * len(kinds) + np.searchsorted(kinds, mark.view(U))
            order = np.argsort(known_key)
            known_key, side = np.append(known_key[order], -1), np.append(side[order], 0)
            at_mark = np.searchsorted(known_key[:-1], key)
            own = np.where(known_key[at_mark] == key, side[at_mark], 0)
            opens = ~follows | (own & 2 > 0)
            opens[1:] |= own[:-1] & 1 > 0
            first = np.flatnonzero(opens)
            total = np.add.reduceat(m, first)
            last = np.r_[first[1:], len(edge)] - 1
            name = mix(mix(edge[first]) + edge[last] + mix(total.astype(U) << U(32) | (last - first).astype(U)))
            claims = pa.StructArray.from_arrays([pa.array(s[first] << 32 | total + (window - 1)), longs(name)], names=["span", "path"])
            # No list of edges is empty, so each text has as many claims as paths begin between its edges.
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(np.diff(np.searchsorted(first, at)), claims)], names=["row", "claims"])

    found = staged(spark, map_arrow(joined, compact, "row long, claims array<struct<span:bigint,path:bigint>>"), "paths")
    known.destroy()
    return found


def merged(spans: np.ndarray) -> list[list[int]]:
    """Sorted, disjoint spans."""
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, spans.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def keep_words(words: list[bytes], spans: list[list[int]]) -> tuple[list[bytes], int]:
    kept, at = [], 0
    for s, e in spans:
        kept += words[at:s]
        at = e
    return kept + words[at:], sum(e - s for s, e in spans)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _claims(spans: DataFrame) -> DataFrame:
    """(row, claims) of (row, span, path)."""
    return spans.groupBy("row").agg(F.collect_list(F.struct("span", "path")).alias("claims"))


def _read(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, values = _flat(lists)
    return at, values.field(0).to_numpy(), values.field(1).to_numpy()


class _Cutter:
    """Cuts spans out of texts. names: the columns of the texts, of which row is left out of the result."""

    def __init__(self, rows: DataFrame, row: str):
        self.rows, self.row, self.types = rows, row, dict(rows.dtypes)
        self.names = [c for c in rows.columns if c != row]
        self.text, self.added = self.names.index("text"), []
        for c in ("n_words", "n_removed", "kept_sha256", "proofs"):
            self.added.append(distinct_name(rows, f"_{c}"))
        self.claims = distinct_name(rows, "_claims")

    def schema(self, columns: list[str]) -> str:
        return ", ".join(f"`{c}` {self.types[c]}" for c in columns)

    def split(self, bits, may: bool, columns: list[str], f, schema: str) -> DataFrame:
        """The texts whose row is in the filter, or isn't, by f."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from f(b.filter(pa.array(_in(bits.value, b.column(b.num_columns - 1).to_numpy()) == may)) for b in batches)

        return map_arrow(self.rows.select(*columns, self.row), run, schema)

    def joined(self, bits, claims: DataFrame, columns: list[str]) -> DataFrame:
        """The texts that have claims, after a shuffle of those alone whose row is in the filter."""
        marked = self.split(bits, True, columns, lambda batches: batches, self.schema([*columns, self.row]))
        right = claims.select(F.col("row").alias(self.claims + "_row"), F.col("claims").alias(self.claims))
        return marked.join(right, F.col(self.row) == F.col(self.claims + "_row"), "left").select(*columns, self.row, self.claims)

    def cut(self, bits, claims: DataFrame) -> DataFrame:
        """names, then added: number of words, of removed ones, digest of the kept ones, and (path, digest of the words, how often) of its claims."""
        # A batch has the columns of names and row, and claims where there are any.
        width, text, names, added = len(self.names), self.text, self.names, self.added
        schema = f"{self.schema(names)}, `{added[0]}` long, `{added[1]}` long, `{added[2]}` string, `{added[3]}` array<struct<path:bigint,digest:binary,times:int>>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, spans, paths = _read(b.column(width + 1)) if b.num_columns > width + 1 else (np.zeros(b.num_rows + 1, np.int64), *[np.zeros(0, np.int64)] * 2)
                texts, n_words, n_removed, digests, proofs, n_proofs = [], [], [], [], [], []
                column = b.column(text).cast(pa.binary())
                for i in range(b.num_rows):
                    value = column[i].as_py()
                    words = (value or b"").split()
                    own = np.stack([spans[at[i] : at[i + 1]] >> 32, spans[at[i] : at[i + 1]] & _LOW], axis=1)
                    # A text that says the same again and again has many claims on a path; they go on as one with their number.
                    found = Counter((path, _digest(words[s : s + n])) for path, (s, n) in zip(paths[at[i] : at[i + 1]].tolist(), own.tolist(), strict=True))
                    proofs += [(path, digest, times) for (path, digest), times in found.items()]
                    n_proofs.append(len(found))
                    own[:, 1] += own[:, 0]
                    kept, gone = keep_words(words, merged(own)) if len(own) else (words, 0)
                    joined = b" ".join(kept)
                    texts.append(None if value is None else joined)
                    n_words.append(len(words))
                    n_removed.append(gone)
                    digests.append(hashlib.sha256(joined).hexdigest())
                new = [pa.array(texts, pa.binary()).cast(pa.string()) if i == text else b.column(i) for i in range(width)]
                kinds = (pa.int64(), pa.binary(), pa.int32())
                proof = pa.StructArray.from_arrays([pa.array([x[k] for x in proofs], kind) for k, kind in enumerate(kinds)], names=["path", "digest", "times"])
                yield pa.RecordBatch.from_arrays([*new, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), _lists(np.array(n_proofs, np.int64), proof)], names=[*names, *added])

        return map_arrow(self.joined(bits, claims, names), run, schema).unionByName(self.split(bits, False, names, run, schema))

    def by_words(self, bits, claims: DataFrame, window: int) -> DataFrame:
        """(row, span, path) of the windows under the claims whose words come again, compared by a digest of the words themselves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, spans, _ = _read(b.column(2))
                row, column = b.column(1).to_numpy(), b.column(0).cast(pa.binary())
                for i in np.flatnonzero(np.diff(at)):
                    words = column[int(i)].as_py().split()
                    starts = sorted({s for x in spans[at[i] : at[i + 1]].tolist() for s in range(x >> 32, (x >> 32) + (x & _LOW) - window + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), row[i])), pa.array(starts, pa.int32()), pa.array([_digest(words[s : s + window]) for s in starts], pa.binary())], names=["row", "start", "digest"])

        found = staged(self.rows.sparkSession, map_arrow(self.joined(bits, claims, ["text"]), run, "row long, start int, digest binary"), "digests")
        again = found.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest")
        span = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.lit(window).cast("long"))
        return found.join(again, "digest", "left_semi").select("row", span.alias("span"), F.lit(0).cast("long").alias("path"))


def _removed(spark: SparkSession, docs: DataFrame, window: int, k: int, hash_bits: int) -> tuple[DataFrame, list[str]]:
    """docs with their kept words, and the names of the columns that tell how many words there were and went, and the digest of the kept ones."""
    row = distinct_name(docs, "_row")
    rows = staged(spark, docs.withColumn(row, F.monotonically_increasing_id()), "texts")
    texts = staged(spark, by_row(edges(spark, rows.select("text", F.col(row).alias("row")), window, k, hash_bits)), "edges")
    found = paths(spark, texts, window)
    forget(spark, texts)
    cutter = _Cutter(rows, row)

    def settled(claims: DataFrame) -> DataFrame:
        # Most texts have no repeated span: only those whose bit is set are sent to where their spans are.
        bits = spark.sparkContext.broadcast(bit_filter(claims, "row"))
        out = staged(spark, cutter.cut(bits, claims), "cut")
        bits.destroy()
        return out

    out = settled(found)
    proofs = out.select(F.inline(cutter.added[3])).groupBy("path").agg(F.sum("times").alias("c"), F.min("digest").alias("d0"), F.max("digest").alias("d1"))
    wrong = staged(spark, proofs.where("c < 2 OR d0 <> d1").select("path"), "wrong")
    if not wrong.isEmpty():
        forget(spark, out)
        each = found.select("row", F.inline("claims"))
        doubtful = staged(spark, _claims(each.join(wrong, "path", "left_semi")), "claims")
        bits = spark.sparkContext.broadcast(bit_filter(doubtful, "row"))
        sure = each.join(wrong, "path", "left_anti").select("row", "span", "path")
        claims = staged(spark, _claims(sure.unionByName(cutter.by_words(bits, doubtful, window))), "claims")
        out = settled(claims)
        forget(spark, doubtful, claims)
    forget(spark, rows, found, wrong)
    return out, cutter.added[:3]


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 35, k: int = 18, hash_bits: int = 64) -> DataFrame:
    """All columns of docs, with text its kept words joined by one space, and n_words, n_removed, kept_sha256.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, compared unchanged. A word goes if a window of `window` words that covers it starts anywhere
    else too, in the same document included; windows are judged on the input. A null text stays null, has no words and counts as empty for kept_sha256;
    shorter texts than a window keep all words; repeated rows are occurrences of their own; an empty table gives no row. Columns of docs that are called
    n_words, n_removed or kept_sha256 are replaced. hash_bits: bits of the hashes of words sequences; with few of them many are the same by chance, which
    changes no result.
    """
    new = ["n_words", "n_removed", "kept_sha256"]
    names = [c for c in docs.columns if c.lower() not in new]
    out, added = _removed(spark, docs.select(*names), window, k, hash_bits)
    return out.select(*names, *(F.col(a).alias(c) for a, c in zip(added, new, strict=True)))


def without_repeats(spark: SparkSession, docs: DataFrame, window: int = 35, k: int = 18) -> DataFrame:
    """docs, of whose columns only text is changed: what remove_repeats keeps of it."""
    return _removed(spark, docs, window, k, 64)[0].select(*docs.columns)
