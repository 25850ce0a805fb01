"""Vector codes: product quantisation with exact integers over distinct parts.

Components become integers, and a vector is cut into parts. Equal parts of one position are one row with a weight, so a vector that occurs a million times costs
no more than one. Each round of Lloyd's algorithm assigns the distinct parts to the nearest entry of their position's codebook and adds up weighted sums, a
row for each entry and task; only the codebooks, of a size fixed by the parameters, reach the driver and all tasks. Codes and errors of the distinct parts are
then joined to the vectors that have them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import floor, ldexp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct_name, forget, map_arrow, staged

LONG = (1 << 63) - 1
#: Parts that are compared with a codebook at a time.
BLOCK = 1 << 13
_LABEL = "label"


def _integers(x: np.ndarray, scale: float) -> list[str]:
    """floor(scale * x) in decimals. Where scale * x is beyond a long it is worked out exactly."""
    y = np.floor(x * scale)
    if not len(y) or np.abs(y).max() < ldexp(1, 62):
        return y.astype(np.int64).astype(str).tolist()
    return [str(int(b)) if abs(b) < ldexp(1, 52) else str(floor(Fraction(float(a)) * Fraction(scale))) for a, b in zip(x, y, strict=True)]


def _vectors(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, where each one's components begin and end in the values, values): a row is left out if it is null or has a null or non-finite component."""
    lists = batch.column(column)
    first = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.cast(pa.float64())
    x = values.to_numpy(zero_copy_only=False)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(x) | np.asarray(values.is_null()))])
    whole = np.asarray(lists.is_valid()) & (odd[first[1:]] == odd[first[:-1]])
    rows = np.flatnonzero(whole)
    return rows, np.stack([first[:-1][rows], first[1:][rows]], 1), x


def _matrix(parts: list[str], width: int) -> np.ndarray:
    """Integers of parts in decimals, as longs if the squares of differences surely fit in one and as Python integers otherwise."""
    words = ",".join(parts).split(",") if width else []
    if all(len(w) < 10 for w in words):
        return np.array(words, np.int64).reshape(len(parts), width) if words else np.zeros((len(parts), width), np.int64)
    return np.array([int(w) for w in words], object).reshape(len(parts), width)


def nearest(x: np.ndarray, entries: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row, ties to the lower index; in longs where they hold it, else in Python integers."""
    most = max((abs(v) for e in entries for v in e), default=0)
    narrow = x.dtype != object and x.shape[1] * (int(np.abs(x).max(initial=0)) + most) ** 2 < LONG
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64 if narrow else object)
    c = np.array(entries, np.int64 if narrow else object).reshape(len(entries), x.shape[1])
    for s in range(0, len(x), BLOCK):
        d = np.zeros((len(x[s : s + BLOCK]), len(c)), np.int64 if narrow else object)
        for j in range(x.shape[1]):
            d += (x[s : s + BLOCK, j, None] - c[None, :, j]) ** 2
        at[s : s + BLOCK] = best = d.argmin(1)
        far[s : s + BLOCK] = d[np.arange(len(d)), best]
    return at, far


def _by_position(b: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows of the batch, their integers); columns 0 and 1 are position and part."""
    pos = b.column(0).to_numpy(zero_copy_only=False)
    for p in np.unique(pos):
        rows = np.flatnonzero(pos == p)
        yield int(p), rows, _matrix(b.column(1).take(pa.array(rows)).to_pylist(), width)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by position and entry of rows (pos, entry, n, sums in decimals); whole numbers of any size."""
    held: dict[tuple[int, int], list[int]] = {}
    for b in batches:
        for p, e, n, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = [n, *(int(v) for v in sums.split(",") if v)]
            held[p, e] = [x + y for x, y in zip(held[p, e], own, strict=True)] if (p, e) in held else own
    yield _sums(held)


def _sums(held: dict[tuple[int, int], list[int]]) -> pa.RecordBatch:
    keys = list(held)
    columns = [pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([",".join(map(str, held[k][1:])) for k in keys], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["pos", "entry", "n", "sums"])


_SUMS = "pos int, entry int, n long, sums string"


def compress(spark: SparkSession, vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = _LABEL) -> tuple[DataFrame, list[list[tuple[int, ...]]]]:
    """((vec_id, label, codes array<int>, error long) of every vector that takes part, codebooks by part and entry).

    Components x become floor(scale * x). A position's codebook starts as that part of the vectors with the smallest ids (ascending; rows that share an id by
    their components; null ids last), as many as there are up to `entries`. Each round assigns every part to the nearest entry, ties to the lower index, and
    replaces each entry by the componentwise floor of its parts' mean; entries that no part is nearest to stay. codes and error are those of a last assignment.
    Vectors that are null or hold a null or non-finite component take no part. Shorter vectors are filled up with zeros, as is the last part where the
    length isn't a multiple of `parts`; an empty vector is one of zeros. Integers may have any size; an error beyond a long is cut to it. Repeated rows all stay,
    other columns are ignored, and an empty table gives no row and no codebooks.
    """
    if entries < 1 or parts < 1:
        raise ValueError("at least one part and one entry")
    source = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    kinds = dict(source.dtypes)
    longest = source.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ends, x = _vectors(b, 2)
            size = ends[:, 1] - ends[:, 0]
            to = np.cumsum(size)
            words = _integers(x[np.repeat(ends[:, 0] - to + size, size) + np.arange(to[-1] if len(to) else 0)], scale)
            made = []
            for s, e in zip((to - size).tolist(), to.tolist(), strict=True):
                own = words[s:e] + ["0"] * (parts * width - (e - s))
                made.append([",".join(own[p * width : (p + 1) * width]) for p in range(parts)])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(made, pa.list_(pa.string()))], names=["vec_id", "label", "parts"])

    held = map_arrow(source, cut, f"vec_id {kinds['vec_id']}, label {kinds['label']}, parts array<string>")
    held = staged(spark, held.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    start = held.orderBy(F.col("vec_id").asc_nulls_last(), F.transform("parts", lambda p: F.transform(F.split(p, ","), lambda w: F.when(w != "", w.cast("double")))), "parts").limit(entries).select("parts").collect()
    if not start:
        return held.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), []
    books = [[tuple(int(v) for v in r["parts"][p].split(",") if v) for r in start] for p in range(parts)]

    each = held.select("uid", F.posexplode("parts").alias("pos", "part"))
    distinct = staged(spark, each.groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")

    def assigned(books: list) -> DataFrame:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], list[int]] = {}
            for b in batches:
                n = b.column(2).to_numpy(zero_copy_only=False)
                for p, rows, x in _by_position(b, width):
                    at, _ = nearest(x, books[p])
                    w = n[rows].astype(object if x.dtype == object or int(n.max()) * len(rows) > 1 << 32 else np.int64)
                    for e in np.unique(at):
                        own = [int(w[at == e].sum()), *(int(v) for v in (x[at == e] * w[at == e, None]).sum(0))]
                        total[p, int(e)] = [a + c for a, c in zip(total[p, int(e)], own, strict=True)] if (p, int(e)) in total else own
            yield _sums(total)

        return map_arrow(map_arrow(distinct, sums, _SUMS).repartition("pos", "entry"), _added, _SUMS)

    for _ in range(rounds):
        for r in assigned(books).collect():  # a row for each entry at most
            if r["n"]:
                books[r["pos"]][r["entry"]] = tuple(int(v) // r["n"] for v in r["sums"].split(",") if v)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for p, rows, x in _by_position(b, width):
                code[rows], far = nearest(x, books[p])
                error[rows] = np.minimum(far, LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code), pa.array(error)], names=["pos", "part", "code", "error"])

    codes = map_arrow(distinct, coded, "pos int, part string, code int, error long")
    found = each.join(codes, ["pos", "part"]).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("codes"), _total("error").alias("error"))
    out = held.select("uid", "vec_id", "label").join(found, "uid")
    out = staged(spark, out.select("vec_id", "label", F.transform("codes", lambda c: c["code"]).alias("codes"), "error"), "codes")
    forget(spark, held, distinct)
    return out, books


def _total(column: str):
    """The sum of a column of longs that aren't negative, cut to a long."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error of all rows of the same label, null labels together. Sums are combined before they are shuffled and are joined back, so one label may have any share of rows."""
    key = distinct_name(coded, "_label")
    sums = coded.groupBy(F.col("label").alias(key)).agg(_total("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col(key))).drop(key)


def digest(books: list[list[tuple[int, ...]]]) -> str:
    """SHA-256 of all entries' integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for part in books for entry in part for v in entry).encode()).hexdigest()
