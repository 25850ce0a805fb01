"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, staged


def components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that can be reached.

    Large-star and small-star steps alternate until the edges stay as they are. Each step is a minimum by node, combined before the shuffle,
    and an equi-join that can be split where a node has many links. Each round ends in the shared folder. Links with a null end and loops are
    ignored; repeated links count once; an empty table gives an empty one.
    """
    edges = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = staged(spark, edges, "links")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked, before = large.join(small, "u"), edges
        edges = staged(spark, linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        forget(spark, before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
