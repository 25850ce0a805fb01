"""Labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column | str) -> Column:
    """True for the rows that no model is fitted on: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(_id, y): the greatest label of each doc_id that isn't held out, a whole number from 0; null and negative labels and null ids are left out."""
    known = labels.where((F.col(label) >= 0) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, y) of at most `rows` labelled documents, those with the smallest hash of doc_id, without those held out; y is the label, a whole number from 0.

    Null and negative labels and null ids are left out; a doc_id with several labels keeps the greatest, one with several texts that with the smallest hash.
    `rows` bounds what is broadcast here and what comes back: it counts labels, so those of documents that aren't in docs use it up too. An empty table on either side gives no row; other columns are ignored.
    """
    known = known_labels(labels, label).orderBy(F.xxhash64(F.lit(7), "_id"), "_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    return found.groupBy("_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y")).select("text", "y")
