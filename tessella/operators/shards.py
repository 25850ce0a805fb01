"""Shards of score rows: strided selection, merge, exactly-once checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shard(rows: DataFrame, index: int, shards: int, order: str = "sample_idx") -> DataFrame:
    """Every shards-th row, from index."""
    if not 0 <= index < shards:
        raise ValueError("shard index out of range")
    return rows.where(F.pmod(F.col(order), F.lit(shards)) == index)


def coverage(rows: DataFrame, index: str = "sample_idx") -> DataFrame:
    """One row (rows, distinct, low, high), in one pass."""
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(index).alias("distinct"), F.min(index).alias("low"), F.max(index).alias("high"))


def require_coverage(rows: DataFrame, expected: int, index: str = "sample_idx") -> DataFrame:
    """rows; an error unless 0..expected-1 are there once each."""
    r = coverage(rows, index).first()
    if tuple(r) != ((expected, expected, 0, expected - 1) if expected else (0, 0, None, None)):
        raise ValueError(f"{index} must cover 0..{expected - 1} once each: {r.asDict()}")
    return rows


def require_agreement(meta: DataFrame, columns: list[str]) -> DataFrame:
    """meta; an error unless all shards have the same values."""
    kinds = meta.select(*columns).distinct().limit(2).count()
    if kinds > 1:
        raise ValueError(f"shards disagree on {columns}")
    return meta


def merge(shards: list[DataFrame], index: str = "sample_idx") -> DataFrame:
    """All rows of all shards; an index that two of them have is an error. Sort by the index on writing."""
    rows = reduce(DataFrame.unionByName, shards)
    r = coverage(rows, index).first()
    if r["rows"] != r["distinct"]:
        raise ValueError(f"repeated {index}")
    return rows


def used_ratio(meta: DataFrame, tiles: int = 100) -> float | None:
    """The observation ratio of all shards: from selected counts (selected, rows) where all have them, else the ratio that they agree on within 1e-9."""
    r = meta.agg(F.count("*").alias("n"), F.count("selected").alias("s"), F.sum("selected").alias("total"), F.sum("rows").alias("rows"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi")).first()
    if r["s"] not in (0, r["n"]):
        raise ValueError("selected counts are in some shards only")
    if r["s"]:
        return r["total"] / r["rows"] / tiles if r["rows"] else None
    if r["lo"] is not None and r["hi"] - r["lo"] > 1e-9:
        raise ValueError("shards disagree on the ratio")
    return r["lo"]
