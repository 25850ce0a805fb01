"""Ranking and classification metrics over long scores (sample_idx, class_id, score, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_finite(scores: DataFrame) -> DataFrame:
    """scores with an error for a score that is null, NaN or infinite."""
    s = F.col("score")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == F.lit(float("inf")))
    return scores.withColumn("score", F.when(bad, F.raise_error(F.lit("scores must be finite"))).otherwise(s))


def ranked_steps(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, p, tp, rank) of each threshold: positives at it, and positives and rows down to it.

    Scores are summed up by threshold, thresholds by score range; the ranges' totals, RANGES of them for a group at most, are added up in order, and thresholds are only sorted
    within their range. So a group of any size takes many tasks.
    """
    hit = (F.col("target") > 0).cast("long")
    steps = require_finite(scores).groupBy(*by, "score").agg(F.sum(hit).alias("p"), F.count("*").alias("n")).withColumn("range", score_range(F.col("score")))
    before = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = steps.groupBy(*by, "range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    ranges = ranges.select(*by, "range", F.coalesce(F.sum("rp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("bn"))
    within = Window.partitionBy(*by, "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(ranges, [*by, "range"]).select(*by, "p", (F.sum("p").over(within) + F.col("bp")).alias("tp"), (F.sum("n").over(within) + F.col("bn")).alias("rank"))


def average_precision(scores: DataFrame, by: str = "class_id") -> DataFrame:
    """(by, positives, ap): equal scores are one threshold; a class without positives has a null ap. A null class is left out."""
    out = ranked_steps(scores, [by]).groupBy(by).agg(F.sum("p").alias("positives"), F.sum(F.col("p") * F.col("tp") / F.col("rank")).alias("s"))
    return out.select(by, "positives", F.when(F.col("positives") > 0, F.col("s") / F.col("positives")).alias("ap"))


def mean_average_precision(scores: DataFrame) -> DataFrame:
    """One row (macro, weighted, micro, classes): classes without positives are left out of all three; all null where none is left."""
    per = average_precision(scores).where("positives > 0")
    report = per.agg(F.avg("ap").alias("macro"), (F.sum(F.col("ap") * F.col("positives")) / F.sum("positives")).alias("weighted"), F.count("*").alias("classes"))
    return report.join(micro_average_precision(scores))


def micro_average_precision(scores: DataFrame) -> DataFrame:
    """One row (micro): all classes with positives as one ranking, by ranges of scores like any other."""
    known = scores.groupBy("class_id").agg(F.max((F.col("target") > 0).cast("int")).alias("any")).where("any = 1").select("class_id")
    steps = ranked_steps(scores.join(known, "class_id", "left_semi").withColumn("all", F.lit(0)), ["all"])
    return steps.agg((F.sum(F.col("p") * F.col("tp") / F.col("rank")) / F.sum("p")).alias("micro"))


#: Ranges on either side of 0.
RANGES = 1 << 16


def score_range(score: Column) -> Column:
    """A whole number from -RANGES to RANGES that grows with the score, whatever its magnitude; scores in [0, 1] share half of those above 0."""
    squashed = score / (F.abs(score) + 1.0)
    return F.floor(squashed * RANGES).cast("int")


def ap_at_k(scores: DataFrame, ks: list[int]) -> DataFrame:
    """(class_id, k, positives, ap) for each k: ties go to the lower sample_idx; the denominator is min(positives, k); null without positives."""
    if not ks:
        raise ValueError("ks must not be empty")
    most = max(ks)
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("score"), "sample_idx"))
    top = scores.withColumn("rank", rank).where(F.col("rank") <= most)
    run = Window.partitionBy("class_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("target") > 0).cast("long")
    top = top.select("class_id", "rank", hit.alias("hit"), F.sum(hit).over(run).alias("tp"))
    support = scores.groupBy("class_id").agg(F.sum(hit).alias("positives"))
    sums = [F.sum(F.when((F.col("rank") <= k) & (F.col("hit") > 0), F.col("tp") / F.col("rank")).otherwise(0.0)).alias(f"s{k}") for k in ks]
    per = support.join(top.groupBy("class_id").agg(*sums), "class_id", "left")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"s{k}", F.lit(0.0)).alias("s")) for k in ks)))
    per = per.select("class_id", "positives", rows.alias("r"))
    return per.select("class_id", F.col("r.k").alias("k"), "positives", F.when(F.col("positives") > 0, F.col("r.s") / F.least(F.col("positives"), F.col("r.k"))).alias("ap"))


def map_at_k(scores: DataFrame, ks: list[int], group: Column | None = None) -> DataFrame:
    """(k, map, classes), or (group, k, map, classes): the mean over classes with positives."""
    per = ap_at_k(scores, ks).where("positives > 0")
    if group is not None:
        per = per.withColumn("group", group)
    return per.groupBy(*(["group"] if group is not None else []), "k").agg(F.avg("ap").alias("map"), F.count("*").alias("classes"))


def retrieval_report(scores: DataFrame, ks: list[int], base: int, classes: int) -> DataFrame:
    """(group, k, map, classes) for all classes, and for base (class_id < base) and novel ones; callers give base only where the vocabulary is the one it was made for."""
    every = map_at_k(scores, ks).select(F.lit("all").alias("group"), "k", "map", "classes")
    if base >= classes:
        return every
    return every.unionByName(map_at_k(scores, ks, F.when(F.col("class_id") < base, "base").otherwise("novel")))


def top1_accuracy(scores: DataFrame) -> DataFrame:
    """One row (samples, correct, accuracy): the best score of each sample, the lower class of equal ones, against its target class."""
    best = scores.groupBy("sample_idx").agg(F.max(F.struct("score", (-F.col("class_id")).alias("c"), "target")).alias("b"))
    hit = (F.col("b.target") > 0).cast("long")
    return best.agg(F.count("*").alias("samples"), F.sum(hit).alias("correct"), F.avg(hit.cast("double")).alias("accuracy"))
