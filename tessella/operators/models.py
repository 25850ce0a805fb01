"""The interface of scorers: images in, arrays of scores or features out.

No network is part of this library. A Scorer is made once per Python worker and called with batches; StubScorer stands in for one with numbers that follow
from the sample and the class alone, so plans around it can be run and tested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..storage import bound_batches, ship


class Scorer(Protocol):
    def __call__(self, batch: pd.DataFrame) -> np.ndarray:
        """One row of numbers for each row of the batch."""


class StubScorer:
    """Deterministic numbers in [0, 1) from a key column; for tests and dry runs, not a model."""

    def __init__(self, width: int, key: str = "sample_idx", salt: str = ""):
        self.width, self.key, self.salt = width, key, salt

    def __call__(self, batch: pd.DataFrame) -> np.ndarray:
        def row(k) -> np.ndarray:
            seed = int.from_bytes(hashlib.sha256(f"{self.salt}:{k}".encode()).digest()[:8], "big")
            return np.random.default_rng(seed).random(self.width)

        return np.stack([row(k) for k in batch[self.key]]) if len(batch) else np.zeros((0, self.width))


class ColumnScorer:
    """Scores that are already there: an array column of the rows, from a cache for instance; column `tiles`, where given, adds its length times `per_tile`."""

    def __init__(self, column: str, per_tile: float = 0.0):
        self.column, self.per_tile = column, per_tile

    def __call__(self, batch: pd.DataFrame) -> np.ndarray:
        found = np.stack([np.asarray(v, np.float64) for v in batch[self.column]]) if len(batch) else np.zeros((0, 0))
        return found + self.per_tile * np.array([len(t) for t in batch["tiles"]])[:, None] if self.per_tile and len(batch) else found


def score(rows: DataFrame, make: Callable[[], Scorer], out: str = "scores") -> DataFrame:
    """rows with column out: array<double>. make runs once in each task, so what it loads is shared by its batches."""
    return score_each(rows, {out: make})


def score_each(rows: DataFrame, makes: dict[str, Callable[[], Scorer]]) -> DataFrame:
    """rows with a column array<double> of each scorer, by name. All of them get the same rows, in one worker of each task: a chain of them would hold as many workers at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = {out: make() for out, make in makes.items()}
        for b in batches:
            yield b.assign(**{out: list(np.asarray(scorer(b), np.float64)) for out, scorer in scorers.items()})

    ship(rows.sparkSession)
    bound_batches(rows.sparkSession)
    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, *((out, "array<double>") for out in makes)]))


def route(rows: DataFrame, make: Callable[[], Scorer], tiles: int = 100) -> DataFrame:
    """(rows..., tile, score) in long form: the router's score of each tile."""
    from pyspark.sql import functions as F

    return score(rows, make, "router_scores").select(*rows.columns, F.posexplode("router_scores").alias("tile", "score")).where(F.col("tile") < tiles)
