"""Exact top-k inner-product search by distributed histogram selection.

Vectors are packed into blocks and dealt onto a grid of cells, query groups by candidate groups, so that every query meets every candidate once
and no task holds more than one group of queries and one block of candidates. Each round scores everything, adds up score histograms by query,
and narrows the range that holds the kth best score; when ranges are one integer wide, a last pass filters by them and breaks ties by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, partitions, staged

BLOCK_ROWS = 4096
#: Vectors for which a partition of its own is worth while.
LEAST_ROWS = 1024
GROUP_QUERIES = 1024
BINS = 256
LONG = (1 << 63) - 1
_CELL = "qg int, cg int, kind int, uid long, id long, dim int, ids binary, payload binary, lo long, width long"


def quantised(vectors: list, scale: float) -> list:
    """floor(scale * x) of each component, as Python integers only where longs are too narrow; None for a vector that takes no part.

    Where scale * x is beyond a double, it is worked out exactly.
    """
    out: list = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
        if x is None or not np.isfinite(x).all():
            out.append(None)
            continue
        y = np.floor(scale * x)
        if (np.abs(y) < 2.0**62).all():
            out.append(y.astype(np.int64))
        else:
            out.append(np.array([int(c) if np.isfinite(c) else floor(Fraction(float(a)) * Fraction(scale)) for a, c in zip(x, y, strict=True)], object))
    return out


def _norm(v: np.ndarray) -> float:
    """The length of a vector, infinite where its square may be beyond a double."""
    most = max(map(abs, v.tolist()), default=0) if v.dtype == object else 0
    return float(np.sqrt((v.astype(np.float64) ** 2).sum())) if most < 1 << 500 else float("inf")


def _packed(rows: list) -> tuple[int, bytes]:
    """Dimension and bytes of a block; shorter vectors are filled up with 0. The first byte says which type the integers have."""
    dim = max(map(len, rows), default=0)
    wide = any(r.dtype == object for r in rows)
    m = np.zeros((len(rows), dim), object if wide else np.int64)
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    if wide:
        return dim, b"o" + ",".join(map(str, m.ravel())).encode()
    most = int(np.abs(m).max(initial=0))
    kind = next(k for k, top in (("b", 127), ("h", 32767), ("i", 2**31 - 1), ("q", LONG)) if most <= top)
    return dim, kind.encode() + m.astype(kind).tobytes()


def _unpacked(dim: int, data: bytes, rows: int) -> np.ndarray:
    if data[:1] == b"o":
        return np.array([int(x) for x in data[1:].decode().split(",") if x], object).reshape(rows, dim)
    return np.frombuffer(data, data[:1].decode(), offset=1).reshape(rows, dim).astype(np.int64)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles, longs or Python integers, whichever is the first to hold them. Beyond a long they are cut to its range."""
    dim = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) if x.shape[1] < dim else x for x in (q, c))
    most = dim * int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0))
    if most < 1 << 53:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < LONG:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return np.clip(q.astype(object) @ c.astype(object).T, -LONG, LONG).astype(np.int64)


def _bin(scores: np.ndarray, lo: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Which bin, counted from lo; uint64 arithmetic, as a range may be as wide as a long."""
    return ((scores.astype(np.uint64) - lo.astype(np.uint64)) // width.astype(np.uint64)).astype(np.uint64)


def top_k(spark: SparkSession, vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query row (a SQL condition over vec_id), all rows where there are fewer.

    Ties go to the smaller vec_id. A row is never its own candidate; another row with the same vec_id or vector is. Vectors that are null, or hold a
    null or non-finite component, and rows with a null vec_id take no part. Vectors of different lengths are filled up with 0.
    Scores beyond a long are cut to its range. Other columns are ignored; an empty table gives no row.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for b in batches:
            ids, vecs = b.column(0).to_pylist(), quantised(b.column(1).to_pylist(), scale)
            rows = [(i, v) for i, v in zip(ids, vecs, strict=True) if i is not None and v is not None]
            for at in range(0, len(rows), BLOCK_ROWS):
                part = rows[at : at + BLOCK_ROWS]
                dim, data = _packed([v for _, v in part])
                norm = max(_norm(v) for _, v in part)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((block, pa.int64()), (dim, pa.int32()), (np.array([i for i, _ in part], np.int64).tobytes(), pa.binary()), (data, pa.binary()), (norm, pa.float64()))], names=["block", "dim", "ids", "payload", "norm"])
                block += 1 << 20

    # Each block adds histogram rows of its own to every query, so a small table isn't cut into many.
    dealt = max(1, min(partitions(spark), -(-vectors.count() // LEAST_ROWS)))
    source = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")).repartition(dealt)
    blocks = staged(spark, map_arrow(source, pack, "block long, dim int, ids binary, payload binary, norm double"), "blocks")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                m = _unpacked(r["dim"], r["payload"], len(ids))
                data = [_packed([x])[1] for x in m]
                norm = [_norm(x) for x in m]
                yield pa.RecordBatch.from_arrays([pa.array(r["block"] + np.arange(len(ids)), pa.int64()), pa.array(ids), pa.array([r["dim"]] * len(ids), pa.int32()), pa.array(data, pa.binary()), pa.array(norm, pa.float64())], names=["uid", "id", "dim", "payload", "norm"])

    queries = map_arrow(blocks, rows, "uid long, id long, dim int, payload binary, norm double")
    queries = queries.withColumn("vec_id", F.col("id")).where(is_query).drop("vec_id")
    queries = staged(spark, queries, "queries")
    n, longest = queries.agg(F.count("*"), F.max("norm")).first()
    widest = blocks.agg(F.max("norm")).first()[0] or 0.0
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = -(-n // GROUP_QUERIES)
    spread = max(1, min(-(-2 * partitions(spark) // groups), blocks.count()))
    most = longest * widest * (1 + 1e-9) + 2
    bound = int(most) if most < LONG // 2 else LONG // 2
    state = queries.select("uid", F.lit(-bound).cast("long").alias("lo"), F.lit(-(-(2 * bound + 1) // BINS)).cast("long").alias("width"))

    def cells(state: DataFrame) -> DataFrame:
        left = queries.join(state, "uid").select(F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("qg"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("cg"), F.lit(0).alias("kind"), "uid", "id", "dim", F.lit(None).cast("binary").alias("ids"), "payload", "lo", "width")
        right = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qg"), F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int").alias("cg"), F.lit(1).alias("kind"), F.col("block").alias("uid"), F.lit(None).cast("long").alias("id"), "dim", "ids", "payload", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("width"))
        return left.unionByName(right).repartition(groups * spread, "qg", "cg").sortWithinPartitions("qg", "cg", "kind", "uid")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(rows of queries, their ids, lo, width, candidate ids, scores); a row's score with itself is masked."""
        cell, held, made = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if cell != (r["qg"], r["cg"]):
                    cell, held, made = (r["qg"], r["cg"]), [], None
                if r["kind"] == 0:
                    held.append(r)
                    continue
                if not held:
                    continue
                if made is None:
                    dim = max(x["dim"] for x in held)
                    ms = [_unpacked(x["dim"], x["payload"], 1)[0] for x in held]
                    d, data = _packed([np.pad(x, (0, dim - len(x))) for x in ms])
                    made = (_unpacked(d, data, len(held)), *(np.array([x[c] for x in held], np.int64) for c in ("uid", "id", "lo", "width")))
                q, uid, qid, lo, width = made
                ids = np.frombuffer(r["ids"], np.int64)
                c = _unpacked(r["dim"], r["payload"], len(ids))
                for at in range(0, len(q), 256):
                    s = slice(at, at + 256)
                    own = uid[s, None] == r["uid"] + np.arange(len(ids))[None, :]
                    yield uid[s], qid[s], lo[s], width[s], ids, _scores(q[s], c), own

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, _, lo, width, _, score, own in scored(batches):
            inside = (score >= lo[:, None]) & ~own
            bins = np.minimum(_bin(score, lo[:, None], width[:, None]), np.uint64(BINS - 1)).astype(np.int64)
            counts = np.bincount((np.arange(len(uid))[:, None] * BINS + bins)[inside], minlength=len(uid) * BINS).reshape(len(uid), BINS)
            # The kth best of all is no worse than the kth best of a block, so lower bins of the block can't hold it.
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            row, col = np.nonzero((counts > 0) & (above < k))
            yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(col, pa.int64()), pa.array(counts[row, col], pa.int64())], names=["uid", "bin", "n"])

    width = 0
    while width != 1:
        width = state.agg(F.max("width")).first()[0]
        found = map_arrow(cells(state), histograms, "uid long, bin long, n long").groupBy("uid", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("uid").orderBy(F.desc("bin"))
        found = found.withColumn("above", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["above"])
        # What lies above the range is in its top bin, so sums from the top are right; a query with fewer than k candidates keeps them all.
        at = found.where(f"above < {k} and above + n >= {k}").select("uid", "bin")
        state = state.join(at, "uid", "left").select("uid", F.expr(f"if(bin is null, -{LONG}, lo + bin * width)").alias("lo"), F.expr(f"if(bin is null, 1, (width + {BINS - 1}) div {BINS})").alias("width"))
        state = staged(spark, state, "ranges")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, qid, lo, _, ids, score, own in scored(batches):
            out = []
            for i in range(len(uid)):
                sure = np.flatnonzero((score[i] > lo[i]) & ~own[i])
                tied = np.flatnonzero((score[i] == lo[i]) & ~own[i])
                if len(tied) > k:
                    tied = tied[np.argsort(ids[tied], kind="stable")[:k]]
                at = np.concatenate([sure, tied])
                if len(at) > k:
                    at = at[np.lexsort((ids[at], -score[i][at]))[:k]]
                out.append((np.full(len(at), uid[i]), np.full(len(at), qid[i]), ids[at], score[i][at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["uid", "query_id", "vec_id", "score"])

    best = map_arrow(cells(state), kept, "uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
