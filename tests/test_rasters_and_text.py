"""Resizing, mosaics, exact decimals, pooled features and published pairs, against plain Python."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessella.functions import codec
from tessella.operators import rasters, selection
from tessella.sources import writers


def plain_resize(image, width, height, kind, top=None):
    def line(values, out):
        n, scale = len(values), len(values) / out
        wide, got = max(scale, 1.0), []
        for i in range(out):
            centre = (i + 0.5) * scale
            reach = {"bilinear": 1.0, "bicubic": 2.0}[kind] * wide
            at = range(max(0, math.floor(centre - reach + 0.5)), min(n, math.floor(centre + reach + 0.5)))
            w = []
            for k in at:
                x = abs((k - centre + 0.5) / wide)
                w.append(max(0.0, 1 - x) if kind == "bilinear" else (1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0))
            v = sum(a * values[k] for a, k in zip(w, at, strict=True)) / sum(w)
            got.append(v if top is None else min(max(math.floor(v + 0.5), 0), top))
        return got

    wide = [line(r, width) for r in image]
    return [list(r) for r in zip(*(line(list(c), height) for c in zip(*wide, strict=True)), strict=True)]


@pytest.mark.parametrize("kind", ["bilinear", "bicubic"])
@pytest.mark.parametrize("width, height, top", [(5, 3, None), (9, 20, None), (1, 1, None), (6, 7, 255)])
def test_resize(spark, kind, width, height, top):
    rng = random.Random(width)
    images = {("a", 0): (7, 4), ("a", 1): (7, 4), ("b", 0): (16, 31), ("c", 0): (1, 1), ("d", 0): (width, height)}
    made = {k: [[float(rng.randrange(256)) for _ in range(w)] for _ in range(h)] for k, (w, h) in images.items()}
    rows = [(*k, y, x, v) for k, image in made.items() for y, r in enumerate(image) for x, v in enumerate(r)]
    got = rasters.resized(spark.createDataFrame(rows, "image string, channel int, y int, x int, value double").repartition(5), width, height, kind, ("image", "channel"), top=top).collect()
    assert len(got) == len(images) * width * height
    want = {k: plain_resize(image, width, height, kind, top) for k, image in made.items()}
    for r in got:
        # Of rounded values, a half may go either way.
        assert abs(r["value"] - want[r["image"], r["channel"]][r["y"]][r["x"]]) < (1e-6 if top is None else 1.01)


def test_tiles_of_mosaics(spark):
    """Sides that aren't multiples of the grid; one mosaic that is too small for any tile."""
    rows = [("m", y, [y * 1000 + x for x in range(37)]) for y in range(45)] + [("s", y, [0] * 9) for y in range(50)]
    got = rasters.mosaic_tiles(spark.createDataFrame(rows, "mosaic string, y int, pixels array<int>").repartition(4)).collect()
    assert sorted(r["tile"] for r in got) == list(range(100)) and {r["mosaic"] for r in got} == {"m"}
    for r in got:
        assert r["tile"] == r["tile_row"] * 10 + r["tile_col"]
        assert r["pixels"] == [[(r["tile_row"] * 4 + y) * 1000 + r["tile_col"] * 3 + x for x in range(3)] for y in range(4)]


def test_exact_decimals(spark):
    """Ties on the binary value, values next to ties, tiny, large and odd ones, against Python's own formatting."""
    rng = random.Random(8)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, 0.125, 0.375, 0.00015, 0.66665, 1e-300, 5e-324, 123456789.123456789, 2.0**52 + 0.5, 2.0**53, 2.0**62, 2.0**63, 2.0**90, 9.9e36, 0.99999999999, 999.9999999995, -0.00001, 1 / 3]
    values += [k / 2**n for n in (5, 9, 14) for k in range(1, 40)]
    values += [math.nextafter(v, w) for v in list(values) for w in (math.inf, -math.inf) if abs(v) < 1e36]
    values += [rng.uniform(-200, 200) for _ in range(300)] + [rng.randrange(10**6) / 10**5 for _ in range(300)] + [v for v in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(400)) if abs(v) < 1e36]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for digits in (0, 1, 4, 6, 8, 15):
        for r in frame.select("v", codec.half_even(F.col("v"), digits).alias("t")).collect():
            assert r["t"] == f"{r['v']:.{digits}f}", (r["v"].hex(), digits)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double").select(codec.half_even(F.col("v"), 2)).collect()
    assert [r[0] for r in odd] == [None, None, "inf", "-inf"]
    held = spark.createDataFrame([({3: 0.12345, 1: 2.00005},), ({},), (None,)], "m map<int,double>")
    assert [r[0] for r in held.select(codec.encode_fractions(F.col("m"), 4)).collect()] == [f"1:{2.00005:.4f}|3:{0.12345:.4f}", "", None]
    plan = frame.select(codec.half_even(F.col("v"), 4))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pooled_features(spark):
    rng = random.Random(4)
    cells = {s: [[rng.gauss(0, 1) for _ in range(4)] for _ in range(3)] for s in range(5)}
    text = {c: [rng.gauss(0, 1) for _ in range(4)] for c in range(3)}
    unit = lambda v: [x / max(math.sqrt(sum(y * y for y in v)), 1e-12) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(unit(a), unit(b), strict=True))
    most, mean = (lambda vs: [max(c) for c in zip(*vs, strict=True)]), (lambda vs: [sum(c) / len(c) for c in zip(*vs, strict=True)])
    ways = {
        "patch_score_max": lambda vs, t: max(dot(v, t) for v in vs), "raw_feature_max": lambda vs, t: dot(most(vs), t), "raw_feature_mean": lambda vs, t: dot(mean(vs), t),
        "raw_feature_mean_max": lambda vs, t: dot([(a + b) / 2 for a, b in zip(mean(vs), most(vs), strict=True)], t),
    }
    features = spark.createDataFrame([(s, i, v) for s, vs in cells.items() for i, v in enumerate(vs)], "sample_idx int, tile int, feature array<double>")
    classes = spark.createDataFrame(list(text.items()), "class_id int, proto array<double>")
    for mode, way in ways.items():
        got = selection.pool_features(features, classes, mode).collect()
        assert len(got) == 15
        for r in got:
            assert abs(r["score"] - way(cells[r["sample_idx"]], text[r["class_id"]])) < 1e-9
    with pytest.raises(ValueError):
        selection.pool_features(features, classes, "median")


def test_readers_between_two_steps_see_the_old_pair(spark, tmp_path, monkeypatch):
    root, pair = f"{tmp_path}", lambda n: {"lr": spark.range(n), "hr": spark.range(n + 1)}
    sizes = lambda: {k: df.count() for k, df in writers.read_pair(spark, root, "R").items()}
    with pytest.raises(ValueError, match="nothing"):
        writers.read_pair(spark, root, "R")
    writers.publish_pair(pair(2), root, "R")
    create, seen = writers._create, []

    def spied(*a):
        seen.append(sizes())  # all tables are written, the version isn't published
        return create(*a)

    monkeypatch.setattr(writers, "_create", spied)
    writers.publish_pair(pair(5), root, "R", overwrite=True)
    assert seen == [{"lr": 2, "hr": 3}] and sizes() == {"lr": 5, "hr": 6}

    def raced(*a):  # another writer, which began with the same version, is first
        monkeypatch.setattr(writers, "_create", create)
        writers.publish_pair(pair(7), root, "R", overwrite=True)
        return create(*a)

    monkeypatch.setattr(writers, "_create", raced)
    with pytest.raises(ValueError, match="another writer"):
        writers.publish_pair(pair(9), root, "R", overwrite=True)
    assert sizes() == {"lr": 7, "hr": 8}
    # A file that a writer never came to fill hides nothing and is in nobody's way.
    assert create(spark, f"{root}/R/log/{3:012d}.json", "")
    assert sizes() == {"lr": 7, "hr": 8}
    writers.publish_pair(pair(1), root, "R", overwrite=True)
    assert sizes() == {"lr": 1, "hr": 2}
    with pytest.raises(ValueError, match="exists"):
        writers.publish_pair(pair(1), root, "R")
