"""A corpus pipeline of five stages over documents: quality, near copies, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and is judged on all that its predecessor kept. All but the last return the columns of documents, whatever they are
called; an empty table gives an empty one. Columns other than doc_id, text and source (for mixing) are only passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, mixing, ngram_join, quality, substring
from tessella.llm.common import forget, staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go. A null text is scored as an empty one; equal texts score alike, so ties stay or go together."""
    return quality.good_documents(spark, docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id, null last, and one of rows that are equal. Documents without words all stay."""
    return ngram_join.one_of_each(spark, docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; n_chars is that of the text that is left. No document goes: one without any word left has an empty text, a null text stays null."""
    kept = substring.without_repeats(spark, docs)
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a test item go; documents without words stay."""
    return decontam.clean_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the number of copies it takes of each (a column of docs called copies is replaced). Documents without words aren't taken; equal rows share their copies."""
    return mixing.mixed_documents(spark, docs)


STAGES = [("quality", quality_stage), ("ngram_jaccard", near_copies_stage), ("substring_dedup", repeats_stage), ("decontaminate", benchmark_stage), ("mix_sources", mixing_stage)]

#: Fitted scores, hashed windows and seeds over what earlier stages kept aren't SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(spark, stage(spark, docs, sf_dir), name)
        forget(spark, before)
    return docs
