"""Quality by Bradley-Terry ranking.

A document's strength is linear in features of its form. Pairs of a preferred and another document give a logistic loss on the difference of their
features; the threshold is the quantile of the training strengths that the share of rejected labels asks for.

Every label that isn't held out counts: features are rows of a table, pairs are made in blocks of it, each step of the fit sums slopes over all blocks, and the quantile is found by counting in ever smaller ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct_name, forget, large, map_arrow, staged
from .labelled import held_out, known_labels
from .words import Chunk, chunks

#: Partners of each document of the kind that a fit takes partners for: in memory the rarer one, in blocks of a table the more frequent one.
PARTNERS = 20
#: Documents of the more frequent kind in a block of pairs, about.
BLOCK = 2048
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.uint8)
for _i, _bytes_of in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".?", b",;:", b"!", b"|", b"#$%&*~^<>{}[]\\/=+_@`", b"\n"), 1):
    _CLASS[list(_bytes_of)] = _i
_CLASS[128:] = 2  # bytes of other letters


def features(c: Chunk) -> np.ndarray:
    """One row of numbers for each document of a chunk; all 0 for one without words."""
    m, buf = len(c.count), np.frombuffer(c.data, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in c.texts]) if m else np.zeros(0, np.int64)
    first = np.r_[0, ends].astype(np.int64)
    kinds = _CLASS[buf]
    per_byte = np.zeros((m, 10))
    for k in range(10):
        total = np.r_[0, np.cumsum(kinds == k)]
        per_byte[:, k] = total[first[1:]] - total[first[:-1]]
    n = c.count
    words = np.maximum(n, 1)[:, None]
    doc = np.repeat(np.arange(m), n)
    by_doc = lambda v: np.bincount(doc, v, m)[:, None]
    length = (c.end - c.start).astype(np.float64)
    same = np.zeros(len(doc))
    same[1:] = (c.hash[1:] == c.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((c.hash, doc))
    fresh = np.ones(len(doc))
    fresh[1:] = (c.hash[order][1:] != c.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], fresh, m)[:, None]
    last, head = kinds[np.maximum(c.end - 1, 0)], kinds[np.minimum(c.start, max(len(buf) - 1, 0))]
    single = length == 1
    letters = np.maximum(per_byte[:, 1:3].sum(axis=1, keepdims=True), 1)
    mean = by_doc(length) / words
    columns = [
        np.log1p(n)[:, None], np.log1p(distinct) / np.log1p(words), by_doc(same) / words, mean, np.sqrt(np.maximum(by_doc(length**2) / words - mean**2, 0)),
        per_byte[:, 1:2] / letters, *(per_byte[:, k : k + 1] / words for k in range(3, 10)),
        by_doc(last == 7) / words, by_doc(last == 6) / words, by_doc(last == 5) / words, by_doc(last == 4) / words, by_doc(head == 1) / words,
        by_doc(single & (head == 7)) / words, by_doc(length <= 3) / words, by_doc(length >= 12) / words,
    ]
    out = np.concatenate(columns, axis=1)
    out = np.concatenate([out, np.sqrt(np.abs(out))], axis=1)
    out[n == 0] = 0
    return out


WIDTH = 2 * 21


@dataclass
class QualityModel:
    l2: float = 1e-2
    seed: int = 11
    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))
    w: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    cut: float = 0.0
    spread: float = 1.0
    steps: int = 0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; THRESHOLD at the cut."""
        z = np.clip((self.strength(x) - self.cut) / self.spread, -30, 30) + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.round(1 / (1 + np.exp(-z)), 9)

    def slopes(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the first and second derivatives of the loss of pairs, by their differences."""
        p = 1 / (1 + np.exp(-np.clip(d @ self.w, -30, 30)))
        return d.T @ (p - 1), (d * (p * (1 - p))[:, None]).T @ d

    def stepped(self, grad: np.ndarray, hess: np.ndarray, pairs: int) -> bool:
        """One step of Newton's method, of 25 at most; whether another is needed."""
        step = np.linalg.solve(hess / pairs + self.l2 * np.eye(len(grad)), grad / pairs + self.l2 * self.w)
        self.w = self.w - step
        self.steps += 1
        return self.steps < 25 and np.abs(step).max() >= 1e-8

    def fit(self, x: np.ndarray, y: np.ndarray) -> "QualityModel":
        """Of rows in memory. Without labels of both kinds all strengths are 0, and every document scores THRESHOLD."""
        order = np.lexsort((*x.T, y))  # whatever the order in which rows came
        x, y = x[order], y[order]
        if len(x):
            self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return self
        random = np.random.default_rng(self.seed)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        if len(bad) < len(good):
            d = z[random.choice(good, len(bad) * PARTNERS)] - z[np.repeat(bad, PARTNERS)]
        else:
            d = z[np.repeat(good, PARTNERS)] - z[random.choice(bad, len(good) * PARTNERS)]
        while self.stepped(*self.slopes(d), len(d)):
            pass
        s = np.sort(self.strength(x))
        k = len(bad)
        self.cut = float((s[k - 1] + s[min(k, len(s) - 1)]) / 2)
        self.spread = float(max(s.std() / 4, 1e-6))
        return self


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_id, y, x) of every labelled document that isn't held out: its features as bytes. A doc_id with several texts keeps that with the smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, c in chunks(b.column(2)):
                x = pa.array([r.tobytes() for r in features(c)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(c.count)) for i in (0, 1)), x], names=["doc_id", "h", "x"])

    known = known_labels(labels.where(F.col("quality").isin(0, 1)), "quality")
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    if not large(known):  # Else features of all documents are taken: they are smaller than texts to shuffle.
        rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("_id"), "left_semi")
    rows = map_arrow(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, x binary")
    return rows.join(known, F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.max("y").alias("y"), F.min_by("x", F.struct("h", "x")).alias("x"))


def _matrix(rows: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), np.float64).reshape(len(rows), WIDTH) if len(rows) else np.zeros((0, WIDTH))


def _sums(rows: DataFrame, of) -> np.ndarray:
    """The sum over all batches of what `of` makes of one. Tasks add up theirs; the driver gets one row of numbers of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = of(b) if total is None else total + of(b)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    found = sorted(bytes(r["total"]) for r in map_arrow(rows, run, "total binary").collect())
    return np.sum([np.frombuffer(v, np.float64) for v in found], axis=0)


def pair_blocks(rows: DataFrame, bad: int, good: int) -> DataFrame:
    """(bad, good): lists of the features of documents that meet each other, for labelled features with so many of either kind.

    Blocks have some 2 * PARTNERS documents of the rarer kind, or all, by hash; where many of the other kind would meet them, the block is split and the rarer ones are in each of its parts.
    """
    few, many = min(bad, good), max(bad, good)
    rare = F.col("y") == (0 if bad < good else 1)
    blocks = max(1, few // (2 * PARTNERS))
    parts = -(-many // (blocks * BLOCK))
    part = F.when(rare, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(parts)).cast("int")))
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(0), "_id"), F.lit(blocks)).alias("_block"), F.explode(part).alias("_part"), "y", "x")
    kind = lambda y: F.array_sort(F.collect_list(F.when(F.col("y") == y, F.col("x"))))
    return dealt.groupBy("_block", "_part").agg(kind(0).alias("bad"), kind(1).alias("good")).select("bad", "good")


def differences(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """good - bad of the pairs of a block: each row of the larger side meets PARTNERS of the other in turn, all if there are fewer."""
    few, many = sorted((bad, good), key=len)
    if not len(few):
        return np.zeros((0, WIDTH))
    each = min(PARTNERS, len(few))
    d = np.repeat(many, each, axis=0) - few[np.arange(len(many) * each) % len(few)]
    return d if many is good else -d


def nth(rows: DataFrame, value: str, k: int) -> float:
    """The k-th smallest value, from 0. Values are counted in ranges, and the one that holds the k-th is cut again, until all of its values are equal."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        v, width = F.col(value), (high - low) / 1000
        cut = F.floor((v - low) / width) if width > 0 else v
        counts = rows.where(v.between(low, high)).groupBy(cut.alias("c")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for r in sorted(counts.collect(), key=lambda r: r["c"]):
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits on every labelled document that isn't held out. Without labels of both kinds all strengths are 0, and every document scores THRESHOLD."""
    spark, model = docs.sparkSession, QualityModel()
    rows = staged(spark, labelled_features(docs, labels), "features")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    bad, good = counts.get(0, 0), counts.get(1, 0)
    if bad and good:
        model.mean = _sums(rows.select("x"), lambda b: _matrix(b.column(0)).sum(axis=0)) / (bad + good)
        mean = model.mean
        model.scale = np.maximum(np.sqrt(_sums(rows.select("x"), lambda b: ((_matrix(b.column(0)) - mean) ** 2).sum(axis=0)) / (bad + good)), 1e-6)
        blocks = staged(spark, pair_blocks(rows, bad, good), "pairs")

        def slopes(b: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(1 + WIDTH + WIDTH**2)
            for i in range(b.num_rows):
                d = differences(*(np.clip((_matrix(b.column(k)[i].values) - model.mean) / model.scale, -8, 8) for k in (0, 1)))
                grad, hess = model.slopes(d)
                out += np.concatenate([[len(d)], grad, hess.ravel()])
            return out

        while True:
            total = _sums(blocks, slopes)
            if not model.stepped(total[1 : 1 + WIDTH], total[1 + WIDTH :].reshape(WIDTH, WIDTH), total[0]):
                break
        forget(spark, blocks)

        def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(model.strength(_matrix(b.column(0))))], names=["s"])

        found = staged(spark, map_arrow(rows.select("x"), strengths, "s double"), "strengths")
        below = nth(found, "s", bad - 1)
        # The next strength in order, which may be the same.
        r = found.agg(F.count(F.when(F.col("s") <= below, 1)).alias("n"), F.min(F.when(F.col("s") > below, F.col("s"))).alias("above"), F.stddev_pop("s").alias("spread")).first()
        above = below if r["n"] > bad else r["above"]
        model.cut, model.spread = float((below + above) / 2), float(max(r["spread"] / 4, 1e-6))
        forget(spark, found)
    forget(spark, rows)
    return model


def scored(docs: DataFrame, model: QualityModel, score: str = "score") -> DataFrame:
    """docs with a column `score`: 0 to 1, higher for better. Whole texts count; a null text is scored as an empty one; a column of that name is replaced."""
    names = [c for c in docs.columns if c.lower() != score.lower()]
    types = dict(docs.dtypes)
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(features(c)) for _, c in chunks(b.column(text))]
            yield b.append_column(score, pa.array(np.concatenate([*s, np.zeros(0)]), pa.float64()))

    return map_arrow(docs.select(*names), run, ", ".join(f"`{c}` {types[c]}" for c in names) + f", `{score}` double")


def rank_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; predicted is 1 if score >= THRESHOLD. Labels are learnt from rows that aren't held out.

    Repeated rows get equal scores; a null doc_id is not held out; an empty table gives no row.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches THRESHOLD, with the columns of docs as they are, whatever their names.

    A null text is scored as an empty one; repeated rows all stay or all go; without labels of both kinds every row stays; an empty table gives no row.
    """
    score = distinct_name(docs, "_score")
    return scored(docs, train(docs, labels), score).where(F.col(score) >= THRESHOLD).select(*docs.columns)
