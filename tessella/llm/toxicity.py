"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the presence of words and of word beginnings, hashed. Grades are ordered; P(grade >= j) = sigmoid(w.x - t_j), with one w for all thresholds.
Labels may hold grades, 0 for clean texts. Where they only say toxic or not, the grades of toxic training documents are cut by how many telltale features
they have, so severity then is a matter of how much evidence there is.

Only features that are surely more frequent in toxic documents than in others are kept: those some 20 times as frequent, or, where they leave toxic training
documents without any, as few times as it takes (SURENESS, LEAST_ODDS, COVERED). A document without such a feature is graded as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow
from .labelled import held_out, sample
from .words import LOWER_VALUE, SPACE, Chunk, U, chunks, mix

#: Labelled documents that the regression is fitted on, at most.
SAMPLE = 8000
BITS = 18
#: Features that are kept, at most: those that tell most.
KEPT = 20_000
#: Standard errors below a feature's log-odds at which they still have to exceed the least: the first of these with which so many toxic documents have a feature.
SURENESS, LEAST_ODDS, COVERED = 1.0, (3.0, 2.5, 2.0, 1.5, 1.0, 0.5, 0.0), 0.9
PREFIXES = (4, 5)
#: Punctuation and digits separate words here.
SEPARATORS = SPACE.copy()
SEPARATORS[[b for b in range(128) if not chr(b).isalpha()]] = True


def buckets(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each word and each word beginning, repeats included."""
    m = len(c.count)
    doc = np.repeat(np.arange(m), c.count)
    top = U(64 - BITS)
    found = [(doc, c.hash >> top)]
    buf = np.frombuffer(c.data, np.uint8)
    for n in PREFIXES:
        long = np.flatnonzero(c.end - c.start > n)
        h = np.full(len(long), U(n))
        for i in range(n):
            h = mix(h ^ LOWER_VALUE[buf[c.start[long] + i]])
        found.append((doc[long], h >> top))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)


@dataclass
class ToxicityModel:
    grades: int = 3
    l2: float = 1e-4
    steps: int = 300
    rate: float = 0.3

    def __post_init__(self):
        self.w = np.zeros(1 << BITS, np.float32)
        self.cuts = np.full(self.grades - 1, 1.0)

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> "ToxicityModel":
        """rows: distinct buckets of each document; y: its grade, or 1 for a toxic one and 0 for others. Without toxic documents, or without others, the fit only has thresholds.

        Where grades above 1 occur, the greatest one sets how many there are.
        """
        grade = np.asarray(y, np.int64)
        graded = bool(len(grade)) and int(grade.max()) > 1
        if graded:
            self.grades = int(grade.max()) + 1
            self.cuts = np.full(self.grades - 1, 1.0)
        order = sorted(range(len(rows)), key=lambda i: (grade[i], len(rows[i]), rows[i].tobytes()))
        rows, grade = [rows[i] for i in order], grade[order]
        y = np.minimum(grade, 1)
        if not len(rows):
            return self
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.concatenate(rows).astype(np.int64)
        size, n1, n0 = len(self.w), max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
        has1, has0 = np.bincount(col[y[doc] == 1], minlength=size), np.bincount(col[y[doc] == 0], minlength=size)
        odds = np.log((has1 + 0.5) / (n1 + 1)) - np.log((has0 + 0.5) / (n0 + 1))
        # A feature has to be surer than its counts' chance: the lower bound of its log-odds counts.
        sure = odds - SURENESS * np.sqrt(1 / (has1 + 0.5) + 1 / (has0 + 0.5))
        best = np.argsort(-sure, kind="stable")[:KEPT]
        place = np.full(size, -1)
        for least in LEAST_ODDS:
            kept = best[sure[best] > least]
            place[kept] = np.arange(len(kept))
            if len(np.unique(doc[(place[col] >= 0) & (y[doc] == 1)])) >= COVERED * (y == 1).sum():
                break
        doc, col = doc[place[col] >= 0], place[col[place[col] >= 0]]
        # Grades that no label tells: toxic documents by quantiles of how many telltale features they have.
        many = np.bincount(doc, minlength=len(y)).astype(float)
        if not graded and (y == 1).any():
            steps = np.quantile(many[y == 1], np.arange(1, self.grades - 1) / (self.grades - 1))
            grade[y == 1] = 1 + np.searchsorted(steps, many[y == 1], side="right")
        # exp() keeps thresholds in order.
        w, first, gaps = np.zeros(len(kept)), 1.0, np.zeros(self.grades - 2)
        sums = [np.zeros_like(w), 0.0, np.zeros_like(gaps)]
        balance = np.where(y == 1, 0.5 / n1, 0.5 / n0)
        for _ in range(self.steps):
            cuts = first + np.r_[0, np.cumsum(np.exp(gaps))]
            z = np.bincount(doc, w[col], len(y))
            above = np.c_[np.ones(len(y)), 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30))), np.zeros(len(y))]
            i = np.arange(len(y))
            hi, lo = above[i, grade], above[i, grade + 1]
            mass = np.maximum(hi - lo, 1e-12)
            dhi, dlo = hi * (1 - hi), lo * (1 - lo)  # derivatives by z
            gz = -balance * (dhi - dlo) / mass
            gcut = np.zeros(self.grades - 1)
            np.add.at(gcut, grade[grade > 0] - 1, (balance * dhi / mass)[grade > 0])
            np.add.at(gcut, grade[grade < self.grades - 1], (-balance * dlo / mass)[grade < self.grades - 1])
            grads = (np.bincount(col, gz[doc], len(w)) + self.l2 * w, gcut.sum(), np.array([gcut[j + 1 :].sum() for j in range(len(gaps))]) * np.exp(gaps))
            sums = [s + g**2 for s, g in zip(sums, grads, strict=True)]
            w, first, gaps = (x - self.rate * g / (np.sqrt(s) + 1e-9) for x, g, s in zip((w, first, gaps), grads, sums, strict=True))
        self.w[kept] = w
        self.cuts = first + np.r_[0, np.cumsum(np.exp(gaps))]
        return self

    def grade_chances(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j from 1."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, **parameters) -> ToxicityModel:
    """Fits on at most `rows` labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, c in chunks(b.column(0), lower=True, space=SEPARATORS):
                doc, col = buckets(c)
                both = np.unique(doc << BITS | col)
                first = np.searchsorted(both >> BITS, np.arange(len(c.count) + 1))
                lists = [(both[s:e] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for s, e in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.binary()), b.column(1).slice(at, len(c.count))], names=["x", "y"])

    got = map_arrow(sample(docs, labels, "toxic", rows), run, "x binary, y int").toPandas()
    return ToxicityModel(**parameters).fit([np.frombuffer(bytes(x), np.int32) for x in got["x"]], got["y"].to_numpy(np.int64))


def grade_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, severity, toxic) of every row of docs: severity is the expected grade, from 0; toxic is 1 if P(grade >= 1) reaches the threshold.

    labels has doc_id and toxic: 0 or 1, or grades from 0.

    Whole texts count. A null text is graded as an empty one; repeated rows get equal grades; labels are learnt from rows that aren't held out, a null doc_id isn't;
    an empty table gives no row.
    """
    model = train(docs, labels, rows)
    shared = spark.sparkContext.broadcast(model.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, c in chunks(b.column(1), lower=True, space=SEPARATORS):
                doc, col = buckets(c)
                told = shared.value[col] != 0
                both = np.unique(doc[told] << BITS | col[told])
                out.append(model_chances(np.bincount(both >> BITS, shared.value[both & ((1 << BITS) - 1)].astype(np.float64), len(c.count))))
            p = np.concatenate([*out, np.zeros((0, grades - 1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(p.sum(axis=1), 9)), pa.array((p[:, 0] >= threshold).astype(np.int32))], names=["doc_id", "severity", "toxic"])

    cuts, grades = model.cuts, model.grades
    model_chances = lambda z: 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30)))
    graded = map_arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, severity double, toxic int")
    return graded.select("doc_id", held_out("doc_id").alias("held_out"), "severity", "toxic")
