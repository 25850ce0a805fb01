"""Prefix trie of conversations, with turns shared by equal beginnings.

A turn is known by two 64-bit hashes of its role and text, and a prefix by the sums of its turns' hashes with their places, so prefixes come from running sums over
a range sort, however long one conversation is. The smallest conversation that begins with a prefix owns it. Who owns a prefix owns all longer ones of its own, so the first
owned depth of each conversation is found by binary search: a round for each power of two joins the depths asked about, which are odd multiples of it, to the minima by prefix;
all rounds together read each prefix once. Owned depths are chains that hang on other chains. Their sums go up by doubling: after round k, a chain holds all chains
less than 2**k levels below it. Running sums along each chain then give every node its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_arrow, partitions, staged

#: Ids of one node that are joined before they are dealt to its digest.
BLOCK_IDS = 4096
_MASK = (1 << 64) - 1
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def running(spark: SparkSession, df: DataFrame, group: str, order: list[str], values: list[str]) -> DataFrame:
    """df with each of values, longs, replaced by its sum over the rows of the same group up to and with this one, modulo 2**64. group is a long without nulls.

    Rows are dealt by a range sort, so a group may have any share of them. A task sums its own run of rows and tells the totals of the groups at its end; these, two rows
    for each task at most, are what the driver sees to say with what each run has to begin.
    """
    columns, types = df.columns, dict(df.dtypes)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, held = TaskContext.get().partitionId(), None, np.zeros(len(values), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(columns.index(group)).to_numpy()
            x = np.stack([b.column(columns.index(v)).to_numpy() for v in values])
            edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            total = np.cumsum(x, 1)
            before = np.where(edges > 0, total[:, edges - 1], 0)
            if last == g[0]:
                before[:, 0] -= held
            total -= np.repeat(before, np.diff([*edges, len(g)]), 1)
            last, held = g[-1], total[:, -1].copy()
            out = [pa.array(total[values.index(c)]) if c in values else b.column(i) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.full(len(g), run)), pa.array(np.zeros(len(g), bool))], names=[*columns, "_run", "_end"])
        if last is not None:
            own = {group: int(last)} | {v: int(h) for v, h in zip(values, held, strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([own.get(c)], f.type) for c, f in zip(columns, b.schema, strict=True)] + [pa.array([run], pa.int64()), pa.array([True])], names=[*columns, "_run", "_end"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), "_run long", "_end boolean"])
    dealt = df.repartitionByRange(partitions(spark), group, *order).sortWithinPartitions(group, *order)
    held = staged(spark, map_arrow(dealt, sums, schema), "running")
    # A group that goes on in a later run is the last of this one and the first of that.
    begin: dict[int, tuple[int, list[int]]] = {}
    at, carried = None, [0] * len(values)
    for r in sorted(held.where("_end").select("_run", group, *values).collect(), key=lambda r: r["_run"]):
        if at is not None:
            begin[r["_run"]] = (at, carried)
        own = [r[v] for v in values]
        carried = [(a + b) & _MASK for a, b in zip(carried, own, strict=True)] if r[group] == at else own
        at = r[group]

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(b.columns[: len(columns)])
            run, g = b.column(len(columns)).to_numpy(), b.column(columns.index(group)).to_numpy()
            x = [out[columns.index(v)].to_numpy().copy() for v in values]
            for r in np.unique(run):
                if int(r) in begin:
                    first, add = begin[int(r)]
                    rows = (run == r) & (g == first)
                    for y, a in zip(x, add, strict=True):
                        y[rows] += np.uint64(a & _MASK).astype(np.int64)
            for v, y in zip(values, x, strict=True):
                out[columns.index(v)] = pa.array(y)
            yield pa.RecordBatch.from_arrays(out, names=columns)

    out = map_arrow(held.where("not _end").drop("_end"), begun, ", ".join(f"`{c}` {types[c]}" for c in columns))
    out._staged_path = held._staged_path
    return out


def numbered(spark: SparkSession, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, h1, h2, n_bytes) of every row: its place among the turns of its conversation, from 1, hashes of role and text, and the bytes of its text.

    A null turn comes first; turns that tie are sorted by role, then by the MD5 of their text, and repeated rows all stay. A null role or text is empty. Rows without
    a conversation id are left out, other columns ignored; texts of any length stay where they are, only hashes are moved.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    hashed = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role.alias("role"), F.md5(F.encode(text, "UTF-8")).alias("tie"), F.lit(1).cast("long").alias("pos"), F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"), F.octet_length(text).cast("long").alias("n_bytes"))
    hashed = staged(spark, hashed, "hashed")
    out = staged(spark, (placed := running(spark, hashed, "conv_id", ["turn", "role", "tie"], ["pos"])).select("conv_id", "pos", "h1", "h2", "n_bytes"), "turns")
    forget(spark, hashed, placed)
    return out


def build(spark: SparkSession, turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The nodes of the trie of turns (conv_id, pos, h1, h2, n_bytes), with pos from 1 without gaps, and of further conversations (conv_id) without any turn.

    A node is a prefix that some conversation begins with; the root is the empty one. (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): the smallest conversation with it; its turns; the same of the node above, null for the root; conversations that begin with it; nodes right below;
    childless nodes in its subtree; the sum over its subtree of (n_convs - 1) times the bytes of a node's last text; SHA-256 of the ids of conversations that
    end there, ascending, joined by commas. Conversations with equal turns are told apart by their ids only; no conversation gives no row. Prefixes are compared by 128 bits.
    """
    place = [F.xxhash64("pos", h).alias(k) for h, k in (("h1", "d1"), ("h2", "d2"))]
    prefixes = running(spark, turns.select("conv_id", F.col("pos").alias("depth"), *place, "n_bytes"), "conv_id", ["depth"], ["d1", "d2"])
    summed = prefixes
    power = F.expr("bit_count((depth & -depth) - 1)").alias("power")
    prefixes = staged(spark, prefixes.select("*", power), "prefixes")
    forget(spark, summed)
    minima = staged(spark, prefixes.groupBy("depth", "d1", "d2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes")).select("*", power), "minima")
    lengths = prefixes.groupBy("conv_id").agg(F.max("depth").alias("length"))
    if conversations is not None:
        lengths = lengths.unionByName(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.lit(0).cast("long").alias("length"))).groupBy("conv_id").agg(F.max("length").alias("length"))
    lengths = staged(spark, lengths, "lengths")
    root, n, longest = lengths.agg(F.min("conv_id"), F.count("*"), F.max("length")).first()
    if not n:
        return spark.createDataFrame([], NODE)

    # depth: the deepest prefix known to be another's; up: whose it is.
    search = lengths.select("conv_id", "length", F.when(F.col("conv_id") == root, -1).otherwise(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("up"))
    made = [lengths]
    for power in reversed(range(int(longest).bit_length())):
        step = 1 << power
        asks = (F.col("depth") >= 0) & (F.col("depth") + step <= F.col("length"))
        asked = search.where(asks).select("conv_id", "length", F.col("depth").alias("was"), "up", (F.col("depth") + step).alias("depth"))
        asked = asked.join(prefixes.where(F.col("power") == power).select("conv_id", "depth", "d1", "d2"), ["conv_id", "depth"])
        asked = asked.join(minima.where(F.col("power") == power).select("depth", "d1", "d2", "owner"), ["depth", "d1", "d2"])
        other = F.col("owner") != F.col("conv_id")
        asked = asked.select("conv_id", "length", F.when(other, F.col("depth")).otherwise(F.col("was")).alias("depth"), F.when(other, F.col("owner")).otherwise(F.col("up")).alias("up"))
        search = staged(spark, asked.unionByName(search.where(~asks)), "search")
        forget(spark, *made)
        made = [search]
    owns = F.col("depth") < F.col("length")
    ends = search.select(F.when(owns | (F.col("conv_id") == root), F.col("conv_id")).otherwise(F.col("up")).alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("member"))
    chains = search.where(owns | (F.col("conv_id") == root)).select("conv_id", (F.col("depth") + 1).alias("top"), "length", F.when(F.col("conv_id") != root, F.col("up")).alias("parent"))
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    nodes = nodes.unionByName(spark.createDataFrame([(root, 0, n, 0)], nodes.schema))

    hung = chains.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("length")).agg(F.count("*").alias("n"))
    saved = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    own = chains.join(hung, ["conv_id", "length"], "left").join(saved, "conv_id")
    own = staged(spark, own.select("conv_id", "top", "length", "parent", F.when(F.col("n").isNull(), 1).otherwise(0).cast("long").alias("leaf"), "saved"), "chains")
    whole = _summed_up(spark, own.select("conv_id", F.col("parent").alias("above"), F.col("leaf").alias("leaves"), "saved"), root)
    # What is known of single nodes: chains that hang there, where a chain begins, and where it ends.
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")

    def known(rows: DataFrame, conv_id, depth, children, leaves, saved, parent=none, ends=zero) -> DataFrame:
        return rows.select(conv_id.alias("conv_id"), depth.alias("depth"), children.alias("children"), leaves.alias("leaves"), saved.alias("saved_below"), parent.alias("parent"), ends.cast("long").alias("ends"))

    c = F.col
    parts = [
        known(own.join(whole, "conv_id").where("parent is not null").select("parent", "top", whole["leaves"], whole["saved"]), c("parent"), c("top") - 1, F.lit(1).cast("long"), c("leaves"), c("saved")),
        known(own.where("parent is not null"), c("conv_id"), c("top"), zero, zero, zero, parent=c("parent")),
        known(own, c("conv_id"), c("length"), zero, c("leaf"), zero, ends=F.lit(1)),
    ]
    facts = reduce(DataFrame.unionByName, parts).groupBy("conv_id", "depth").agg(*(F.sum(x).alias(x) for x in ("children", "leaves", "saved_below", "ends")), F.max("parent").alias("parent"))
    found = nodes.join(facts, ["conv_id", "depth"], "left").join(_digests(spark, ends), ["conv_id", "depth"], "left").fillna(0, ["children", "leaves", "saved_below", "ends"])
    above = F.when(c("depth") > 0, F.coalesce("parent", "conv_id"))
    found = found.select("conv_id", (-c("depth")).alias("up"), above.alias("parent_conv_id"), "n_convs", (c("children") + 1 - c("ends")).alias("n_children"), c("leaves").alias("n_leaves"), (c("saved") + c("saved_below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    found = staged(spark, found, "nodes")
    forget(spark, prefixes, minima, search, own, whole)
    out = running(spark, found, "conv_id", ["up"], ["n_leaves", "saved_tokens"])
    forget(spark, found)
    return out.select("conv_id", (-c("up")).alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _summed_up(spark: SparkSession, chains: DataFrame, root: int) -> DataFrame:
    """(conv_id, leaves, saved) of chains (conv_id, above, leaves, saved), each with all that hang below it. Rounds are the logarithm of the longest way down."""
    held = staged(spark, chains, "sums")
    while held.where("above is not null").limit(1).count():
        below = held.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))
        # Nothing is above the root, which most chains may hang on.
        high = F.col("above").isNull() | (F.col("above") == root)
        hops = held.where(F.col("above").isNotNull()).select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        moved = held.where(~high).join(hops, "above", "left").select("conv_id", "leaves", "saved", F.col("next").alias("above"))
        moved = moved.unionByName(held.where(high).select("conv_id", "leaves", "saved", F.lit(None).cast("long").alias("above")))
        moved = moved.join(below, "conv_id", "left").fillna(0, ["leaves_below", "saved_below"])
        before, held = held, staged(spark, moved.select("conv_id", "above", (F.col("leaves") + F.col("leaves_below")).alias("leaves"), (F.col("saved") + F.col("saved_below")).alias("saved")), "sums")
        forget(spark, before)
    return held


def _digests(spark: SparkSession, ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of rows (conv_id, depth, member).

    A range sort deals the members of a node to several tasks, which join ids to strings of a bounded length; as SHA-256 takes its text in order, the strings of one node
    then pass through one task, one after the other.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def flush() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "first", "ids"])

        for b in batches:
            for conv, depth, member in zip(*(c.to_numpy().tolist() for c in b.columns), strict=True):
                if key != (conv, depth) or len(ids) == BLOCK_IDS:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (conv, depth), []
                ids.append(member)
            yield flush()
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        yield flush()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []

        def flush() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])

        for b in batches:
            for conv, depth, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key == (conv, depth):
                    sha.update(b",")
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (conv, depth), hashlib.sha256()
                sha.update(ids.encode())
            yield flush()
        if key:
            out.append((*key, sha.hexdigest()))
        yield flush()

    order = ["conv_id", "depth", "member"]
    blocks = map_arrow(ends.select(*order).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order), joined, "conv_id long, depth long, first long, ids string")
    return map_arrow(blocks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first"), digested, "conv_id long, depth long, ends_sha256 string")
