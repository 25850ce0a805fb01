"""Overlap joins where most boxes lie in one cell, or on top of each other, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import spatial

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def some_boxes(rng, n, side, spread):
    out = []
    for i in range(n):
        x, y = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
        out.append((i, (x, y, x + rng.uniform(0.1, 1) * side, y + rng.uniform(0.1, 1) * side)))
    return out


def brute(left, right):
    return {(i, j) for i, a in left for j, b in right if min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])}


@pytest.mark.parametrize("dense", [16, 300, 1 << 24])
def test_dense_cells(spark, monkeypatch, dense):
    """Tiny boxes in one corner of a wide cell, a heap of equal boxes, large ones over all of them; no cell keeps more pairs than it may."""
    monkeypatch.setattr(spatial, "DENSE", dense)
    rng = random.Random(dense)
    left = some_boxes(rng, 150, 0.05, 0.7) + [(1000 + i, (0.3, 0.3, 0.4, 0.4)) for i in range(40)] + some_boxes(rng, 12, 40.0, 30.0)
    right = some_boxes(rng, 170, 0.05, 0.7) + [(1000 + i, (0.31, 0.31, 0.35, 0.36)) for i in range(30)] + [(5000, (-90.0, -90.0, 90.0, 90.0))]
    left, right = [(k, b) for k, (_, b) in enumerate(left)], [(k, b) for k, (_, b) in enumerate(right)]
    one, two = spark.createDataFrame(left, f"i int, box {BOX}"), spark.createDataFrame(right, f"j int, rbox {BOX}")
    got = spatial.overlap_join(one, two, 1.0).select("i", "j", "overlap").collect()
    assert len(got) == len({(r["i"], r["j"]) for r in got}) and {(r["i"], r["j"]) for r in got} == brute(left, right)


def test_a_cell_is_dealt_to_several_keys(spark, monkeypatch):
    monkeypatch.setattr(spatial, "DENSE", 400)
    rng = random.Random(1)
    one = spark.createDataFrame(some_boxes(rng, 2000, 0.002, 0.49), f"i int, box {BOX}").withColumn("_ll", F.lit(0)).withColumn("_level", F.lit(0)).withColumn("_cx", F.lit(0)).withColumn("_cy", F.lit(0))
    two = one.select(F.col("i").alias("j"), F.col("box").alias("rbox"), F.lit(0).alias("_lr"), "_level", "_cx", "_cy")
    one, two, _ = spatial._thinned(one.where("box.x0 >= 0 AND box.y0 >= 0"), two.where("rbox.x0 >= 0 AND rbox.y0 >= 0"), 1.0, "box", "rbox")
    cell = [*spatial._CELL, "_i", "_j"]
    counts = [r["count"] for r in one.groupBy(*cell).count().collect()]
    assert len(counts) > 30 and max(counts) <= 40
