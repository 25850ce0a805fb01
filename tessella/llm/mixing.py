"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, up to `copies` times over. A copy's virtual finish time is the number of words its source
has sent by its end, divided by the source's weight; copies are sorted by finish time, all sources together, and the first of them that fill the
budget are taken. A source whose copies have run out leaves its share to the others, by weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, distinct_name, map_arrow, partitions, shared_dir, staged
from .words import chunks

WEIGHTS = (1.0, 2.0, 3.0)
COPIES = 3


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie): size is the number of words in the text, 0 for null; tie orders rows that share a doc_id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [c.count for _, c in chunks(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate([*n, np.zeros(0, np.int64)]), pa.int64()), b.column(3)], names=["doc_id", "source", "size", "tie"])

    rows = docs.select("doc_id", "source", "text", F.xxhash64("text", "source").alias("tie"))
    return map_arrow(rows, count, f"doc_id {dict(docs.dtypes)['doc_id']}, source string, size long, tie long")


def running_sum(spark: SparkSession, df: DataFrame, order: list[str], value: str, out: str, group: str | None = None) -> DataFrame:
    """df with column out: the sum of value over the rows of the same group up to and with this one, in that order (of which group is the first, if given).

    A range sort deals rows into even runs, however large a group is; the runs are fixed in the shared folder; the totals of the runs that precede it,
    one number for each run and group in it, are all that a task needs besides its own rows. value and group are longs.
    """
    shared_dir(spark)
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).checkpoint()
    keys = [group] if group else []
    totals = ranged.groupBy(F.spark_partition_id().alias("_run"), *keys).agg(F.sum(value).alias("_sum")).collect()
    before: dict[tuple, int] = {}
    seen: dict = {}
    for r in sorted(totals, key=lambda r: r["_run"]):
        g = r[group] if group else None
        before[r["_run"], g] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + r["_sum"]
    names = ranged.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, sums = TaskContext.get().partitionId(), {}
        for b in batches:
            v = b.column(names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            g = b.column(names.index(group)).to_numpy(zero_copy_only=False) if group else np.zeros(len(v), np.int64)
            total = np.empty(len(v), np.int64)
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(v)] if len(v) else []
            for s, e in zip(edges, edges[1:], strict=False):
                key = int(g[s]) if group else None
                start = sums[key] if key in sums else before.get((run, key), 0)
                total[s:e] = start + np.cumsum(v[s:e])
                sums[key] = int(total[e - 1])
            yield b.append_column(out, pa.array(total))

    return map_arrow(ranged, add, ", ".join(f"`{n}` {t}" for n, t in [*ranged.dtypes, (out, "long")]))


def shares(sizes: list[int], weights: list[float], copies: int) -> list[float]:
    """Targets that add up to the sizes: by weight, none above copies times its size; what is over goes to the rest by weight."""
    budget = float(sum(sizes))
    order = sorted(range(len(sizes)), key=lambda i: (copies * sizes[i] / weights[i], i))
    spent, level, rest = 0.0, 0.0, sum(weights)
    for i in order:
        level = (budget - spent) / rest if rest > 0 else 0.0
        if level <= copies * sizes[i] / weights[i]:
            break
        spent += copies * sizes[i]
        rest -= weights[i]
    return [float(min(copies * s, w * level)) for s, w in zip(sizes, weights, strict=True)]


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, copies: int = COPIES, seed: int = 20) -> DataFrame:
    """(doc_id, source, tie, size, source_size, target, taken, copies_taken) of every row of docs (doc_id, text, source).

    Sources by code point, null last, weigh weights[0], weights[1], ..., repeating; the budget is the words of all documents. taken counts words, with
    repeats. The mix holds whole documents: it ends before the first copy that would exceed the budget. A null or wordless text has size 0 and takes
    0; rows with one doc_id are told apart by their text, equal rows are interchangeable; an empty table gives no row; other columns are ignored.
    The totals by source, as many as there are sources in the recipe, are the only thing that reaches the driver. Reruns agree.
    """
    rows = staged(spark, sized(docs), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    by = [weights[i % len(weights)] for i in range(len(totals))]
    targets = shares([r["size"] for r in totals], by, copies)
    budget = sum(r["size"] for r in totals)
    recipe = spark.createDataFrame([(r["source"], i, w, r["size"], t) for i, (r, w, t) in enumerate(zip(totals, by, targets, strict=True))], "source string, s long, weight double, source_size long, target double")
    shuffled = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8"))
    dealt = rows.join(F.broadcast(recipe) if len(totals) <= BROADCAST_ROWS else recipe, rows["source"].eqNullSafe(recipe["source"])).select("doc_id", rows["source"], "size", "tie", "s", "weight", "source_size", "target", shuffled.alias("h"))
    queued = running_sum(spark, dealt, ["s", "h", "doc_id", "tie"], "size", "sent", "s")
    queued = staged(spark, queued.withColumn("row", F.monotonically_increasing_id()), "queues")
    turn = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    lined = queued.where("size > 0").select("row", "size", "s", turn.alias("turn"), "sent", "source_size", "weight")
    lined = lined.select("row", "size", "s", "turn", ((F.col("turn") * F.col("source_size") + F.col("sent")) / F.col("weight")).alias("finish"))
    mixed = running_sum(spark, lined, ["finish", "s", "turn", "row"], "size", "total")
    took = mixed.where(F.col("total") <= budget).groupBy("row").agg(F.sum("size").alias("taken"), F.count("*").alias("copies_taken"))
    out = queued.join(took, "row", "left").fillna(0, ["taken", "copies_taken"])
    return out.select("doc_id", "source", "tie", "size", "source_size", "target", "taken", "copies_taken")


def mixed_documents(spark: SparkSession, docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that the mix takes, with copies: how often, a count of at least 1. Equal rows share their copies, rounded up for each. A column of docs called copies is replaced."""
    docs = docs.select(*(c for c in docs.columns if c.lower() != "copies"))
    mixed = mix(spark, docs, **parameters).select("doc_id", "tie", "copies_taken")
    per = mixed.groupBy("doc_id", "tie").agg(F.sum("copies_taken").alias("taken"), F.count("*").alias("n")).where("taken > 0")
    key, doc, tie = (distinct_name(docs, x) for x in ("_key", "_doc", "_tie"))
    per = staged(spark, per.select(F.col("doc_id").alias(doc), F.col("tie").alias(tie), F.ceil(F.col("taken") / F.col("n")).cast("int").alias("copies")), "taken")
    if per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        per = F.broadcast(per)
    tied = docs.withColumn(key, F.xxhash64("text", "source"))
    return tied.join(per, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(tie))).select(*docs.columns, "copies")
