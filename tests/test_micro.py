"""Hand-made cases for ties, empty input, bounds and encodings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.config import DataProfile, FusionConfig, Policy, RobustStatistics
from tessella.functions import codec
from tessella.functions import geometry as G
from tessella.functions import scores as S
from tessella.functions import tags as T
from tessella.operators import imagery, metrics, sampling, selection, shards, spatial, splits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def scores(spark, rows):
    return spark.createDataFrame([(i, 0, float(s), t) for i, (s, t) in enumerate(rows)], "sample_idx long, class_id int, score double, target int")


@pytest.mark.parametrize("rows, want", [([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], 5 / 6), ([(1, 0), (1, 1), (1, 0), (1, 0)], 0.25), ([(1, 0), (2, 0)], None)])
def test_average_precision(spark, rows, want):
    got = metrics.average_precision(scores(spark, rows)).first()["ap"]
    assert got is None if want is None else abs(got - want) < 1e-12


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
def test_scores_must_be_finite(spark, bad):
    with pytest.raises(Exception, match="finite"):
        metrics.average_precision(scores(spark, [(bad, 1)])).collect()


def test_ap_at_k(spark):
    rows = [(4, 1), (3, 0), (2, 1), (1, 0)]
    got = {r["k"]: r["ap"] for r in metrics.ap_at_k(scores(spark, rows), [2, 4]).collect()}
    assert abs(got[2] - 0.5) < 1e-12 and abs(got[4] - 5 / 6) < 1e-12
    tied = metrics.ap_at_k(scores(spark, [(1, 0), (1, 1)]), [1]).first()["ap"]
    assert tied == 0.0
    with pytest.raises(ValueError):
        metrics.ap_at_k(scores(spark, rows), [])


def test_micro_equals_one_ranking(spark):
    random.seed(3)
    rows = [(random.choice([0.1, 0.2, 0.5, 5.0, -3.0]), random.randint(0, 1)) for _ in range(60)]
    whole = metrics.average_precision(scores(spark, rows)).first()["ap"]
    assert abs(metrics.micro_average_precision(scores(spark, rows)).first()["micro"] - whole) < 1e-12


def test_ap_ignores_order_and_increasing_transforms(spark):
    random.seed(5)
    rows = [(random.random(), random.randint(0, 1)) for _ in range(40)]
    a = metrics.average_precision(scores(spark, rows)).first()["ap"]
    random.shuffle(rows)
    b = metrics.average_precision(scores(spark, [(math.exp(3 * s), t) for s, t in rows])).first()["ap"]
    assert abs(a - b) < 1e-12


def test_score_algebra(spark):
    lit = F.lit
    fused = lambda lr: one(spark, S.robust_tail(lit(1.0), lit(lr), lit(2.0), lit(1.0), lit(1.0), 0.5, 0.5, 1.0))
    assert fused(4.0) == 3.0 and fused(1.5) == 1.0
    assert abs(one(spark, S.residual_gain(lit(2.0), lit(1.0))) - 2.075) < 1e-12
    assert one(spark, S.normalise_row(F.array(lit(1.0), lit(2.0), lit(3.0)), "row_zscore")) == [-1, 0, 1]
    assert one(spark, S.normalise_row(F.array(lit(3.0), lit(4.0)), "row_l2")) == [0.6, 0.8]
    assert math.isnan(one(spark, S.normalise_row(F.array(lit(3.0)), "row_zscore"))[0])
    with pytest.raises(ValueError):
        S.anchor_fusion(lit(1), lit(1), 1.5)


@pytest.mark.parametrize("raw, want", [("table_tennis", True), ("table_tennis;golf", False), ("tennis; golf", True), ("", False), ("golf\t, tennis", True)])
def test_tokens(spark, raw, want):
    assert one(spark, T.has_token(F.lit(raw), "tennis")) is want


def test_rules(spark):
    def classes(**tags):
        column = F.create_map(*(F.lit(x) for kv in tags.items() for x in (kv[0].replace("__", ":"), kv[1])))
        return [T.class_names()[i] for i in one(spark, T.classify(column))]

    assert len(T.class_names()) == 66
    assert classes(leisure="marina", landuse="port") == ["marina"]
    assert classes(landuse="port") == ["port"]
    assert classes(power="generator", generator__method="wind_turbine") == ["wind_farm"]
    assert classes(highway="primary", bridge="yes") == ["overpass"]
    assert classes(man_made="shipyard", building="yes") == ["shipyard"] and classes(man_made="shipyard") == []
    assert classes(tunnel="yes", highway="trunk") == ["tunnel_opening"]
    assert not one(spark, T.whitelisted(F.create_map(F.lit("boundary"), F.lit("protected_area"))))


def test_thinning_and_rounding(spark):
    rows = spark.createDataFrame([(0, 0.001, 0.0), (1, 0.009, 0.0), (2, -0.005, 0.0)], "ord long, lat double, lon double")
    kept = lambda **k: sorted(r["ord"] for r in spatial.thin_centers(rows, 0.01, **k).collect())
    assert kept() == [0, 2] and kept(rounding="truncate") == [0]
    assert spatial.thin_centers(rows, 0) is rows


def test_area_fractions(spark):
    rows = spark.createDataFrame([(1, [1, 2], 2.0), (1, [2], 1.0)], "patch int, classes array<int>, overlap double")
    got = {r["class_id"]: (r["area"], r["relative"], r["absolute"]) for r in spatial.class_areas(rows, "patch", "classes", F.lit(4.0)).collect()}
    assert got == {1: (2.0, 0.4, 0.5), 2: (3.0, 0.6, 0.75)}


def test_overlap_join_equals_nested_loops(spark):
    random.seed(1)
    boxes = lambda n: [(i, x := random.uniform(-3, 3), y := random.uniform(-3, 3), x + random.random(), y + random.random()) for i in range(n)]
    a, b = boxes(60), boxes(60)
    frame = lambda rows, k, c: spark.createDataFrame(rows, f"{k} int, x0 double, y0 double, x1 double, y1 double").select(k, F.struct("x0", "y0", "x1", "y1").alias(c))
    got = sorted((r["i"], r["j"]) for r in spatial.overlap_join(frame(a, "i", "box"), frame(b, "j", "rbox"), 0.7).collect())
    area = lambda p, q: max(0, min(p[3], q[3]) - max(p[1], q[1])) * max(0, min(p[4], q[4]) - max(p[2], q[2]))
    assert got == sorted((p[0], q[0]) for p in a for q in b if area(p, q) > 0)


def test_polygon_clip(spark):
    ring = lambda ps: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps))
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(2.0).alias("x1"), F.lit(2.0).alias("y1"))
    square = ring([(-1, -1), (1, -1), (1, 1), (-1, 1)])
    hole = ring([(0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5)])
    assert abs(one(spark, G.polygon_overlap(F.array(square), box)) - 1) < 1e-12
    assert abs(one(spark, G.polygon_overlap(F.array(square, hole), box)) - 0.75) < 1e-12
    u = ring([(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)])
    assert abs(one(spark, G.polygon_overlap(F.array(u), box)) - 3) < 1e-12
    assert one(spark, G.polygon_overlap(F.array(ring([(5, 5), (6, 5), (6, 6)])), box)) == 0


def test_codec(spark):
    name = one(spark, codec.format_scene_name(F.lit(7), F.lit(34.5), F.lit(-118.25), F.array(F.lit(1), F.lit(12))))
    assert name == "00007_34.500000_-118.250000_1_12"
    back = one(spark, codec.parse_scene_name(F.lit(f"a/b/{name}.jpg")))
    assert (back["scene_id"], back["lat"], back["lon"], back["labels"]) == (7, 34.5, -118.25, [1, 12])
    assert one(spark, codec.parse_scene_name(F.lit("00007_1.0_2.0_no_class"))) is None
    assert one(spark, codec.half_even(F.lit(0.00015), 4)) == f"{0.00015:.4f}" and one(spark, codec.half_even(F.lit(0.66665), 4)) == f"{0.66665:.4f}"
    assert one(spark, codec.parse_classes(F.lit("1||2| 3"))) == [1, 2, 3] and one(spark, codec.parse_classes(F.lit(""))) == []
    with pytest.raises(Exception, match="label outside"):
        one(spark, codec.multi_hot(F.array(F.lit(-1)), 3))


def test_greedy_sample():
    ids = [str(i) for i in range(30)]
    classes = [[i % 3] for i in range(30)]
    taken = sampling.greedy_pick(ids, classes, 9)
    assert len(taken) == 9 and all(sum(int(t) % 3 == c for t in taken) == 3 for c in range(3))
    assert len(sampling.greedy_pick(["a", "a", "b"], [[], [], []], 5)) == 2
    with pytest.raises(ValueError):
        sampling.greedy_pick(ids, classes, 0)


def test_candidates_keep_the_last(spark):
    scenes = spark.createDataFrame([("2", 0, "a"), ("2", 1, "b"), ("9", 2, "c")], "patch_id string, ord int, v string")
    tiles = spark.createDataFrame([("2",), ("2",)], "patch_id string")
    assert [tuple(r) for r in sampling.paired_candidates(scenes, tiles).select("patch_id", "v").collect()] == [("2", "b")]


def test_splits(spark):
    rows = spark.createDataFrame([([0, 1],), ([1],)], "labels array<int>")
    assert [tuple(r) for r in splits.label_histogram(rows, 3).orderBy(F.desc("count"), "label_id").collect()] == [(1, 2, 1.0), (0, 1, 0.5), (2, 0, 0.0)]
    empty = rows.limit(0)
    assert [r["ratio"] for r in splits.label_histogram(empty, 2).collect()] == [0.0, 0.0]
    twice = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), ("b", "train")], "k string, split string")
    with pytest.raises(ValueError, match="several"):
        splits.require_disjoint(twice, "k")
    with pytest.raises(Exception, match="invalid labels"):
        splits.check_labels(spark.createDataFrame([([66],)], "labels array<int>"), 66, 30).collect()
    with pytest.raises(ValueError, match="twice"):
        splits.map_label_groups(rows, spark.createDataFrame([("a", 1), ("a", 2)], "source_label string, group_id int"), "labels")


def test_imagery(spark):
    window = imagery.time_window(F.lit("2022-01-01").cast("timestamp_ntz"), "2023-01-01", "2023-12-31", 183)
    assert one(spark, window)["tag"] == "default"
    pixels = lambda dark: F.array(*(F.array(*(F.lit(5 if i < dark else 6) for _ in range(3))) for i in range(4)))
    assert one(spark, imagery.image_valid(pixels(1))) is False and one(spark, imagery.image_valid(pixels(0))) is True
    assert len(imagery.crop_tiles(2685, 2680)) == 100 and imagery.crop_tiles(25, 25)[-1] == (99, 18, 18, 20, 20)


def test_shards(spark):
    rows = lambda *i: spark.createDataFrame([(x,) for x in i], "sample_idx long")
    for bad in (rows(0, 1, 3), rows(0, 1, 1, 2)):
        with pytest.raises(ValueError):
            shards.require_coverage(bad, 4)
    assert shards.merge([rows(0, 2), rows(1, 3)]).count() == 4
    with pytest.raises(ValueError):
        shards.merge([rows(0, 1), rows(1)])
    meta = spark.createDataFrame([(10, 100, None), (None, 100, 0.1)], "selected int, rows int, ratio double")
    with pytest.raises(ValueError):
        shards.used_ratio(meta)
    with pytest.raises(ValueError):
        shards.require_agreement(meta.select("ratio"), ["ratio"])


def test_selection(spark):
    policy = spark.createDataFrame([(0, 4), (1, 0)], "class_id int, pc int")
    with pytest.raises(ValueError, match="no score rows"):
        selection.policy_gather(spark.createDataFrame([(0, 0, 4, 1.0)], "sample_idx long, class_id int, pc int, score double"), policy)
    with pytest.raises(ValueError):
        selection.policy_valid(spark.createDataFrame([(0, 101)], "class_id int, pc int"), 1)


def test_configs():
    profile = {"schema_version": 1, "name": "n", "classes": ["a", "b"], "regions": {"r": {}, "s": {}}, "osm": {}, "imagery": {}, "split": {"train_regions": ["r"]}}
    assert DataProfile.of(profile).select(["r,s", "r"]) == ["r", "s", "r"]
    for change in ({"schema_version": 2}, {"classes": ["a", "a"]}, {"split": {"train_regions": ["x"]}}):
        with pytest.raises(ValueError):
            DataProfile.of(profile | change)
    with pytest.raises(ValueError):
        FusionConfig("a", "b", weight=2)
    p = Policy.of({"per_class": [{"name": "a", "Pc": 0}, {"name": "b", "Pc": 100}]}, ["a", "b"])
    assert p.ratio == 0.5 and p.resolve("unknown") == 12 and p.resolve(1) == 100
    with pytest.raises(ValueError):
        Policy.of({"per_class": [{"name": "b", "Pc": 0}]}, ["a"])
    with pytest.raises(ValueError):
        RobustStatistics(("a",), (math.nan,), (0.0,), (0.0,), 1, 1, 1)


def test_sources_and_sinks(spark, tmp_path):
    from tessella.sources import readers, writers

    patches = spark.createDataFrame([(1, 1.0, 2.0, 0.0, 0.0, 1.0, 1.0, [1, 2], {2: 0.66665, 1: 0.33335}, {1: 0.1, 2: 0.2})], "patch_id int, center_lat double, center_lon double, sent_min_lat double, sent_min_lon double, sent_max_lat double, sent_max_lon double, classes array<int>, class_fracs map<int,double>, class_fracs_abs map<int,double>")
    writers.write_csv(writers.scene_index_rows(patches), f"{tmp_path}/scenes")
    back = readers.read_scene_index(spark, f"{tmp_path}/scenes").first()
    assert back["classes"] == [1, 2] and back["class_fracs"] == f"1:{0.33335:.4f}|2:{0.66665:.4f}"
    with pytest.raises(Exception, match="exists"):
        writers.write_csv(writers.scene_index_rows(patches), f"{tmp_path}/scenes")
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        readers.read_csv(spark, f"{tmp_path}/x.csv", "patch_id string", ["patch_id"])
    (tmp_path / "list.txt").write_text("River_1.jpg\nForest_2.jpg\n")
    assert sorted(r["target"] for r in readers.read_image_list(spark, f"{tmp_path}/list.txt", ["River", "Forest"]).collect()) == [0, 1]
    with pytest.raises(Exception, match="unknown class"):
        readers.read_image_list(spark, f"{tmp_path}/list.txt", ["River"]).collect()
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,1],[0,1],[0,0]]]}},{"geometry":{"type":"Polygon","coordinates":[[[-1,0],[1,0],[1,3]]]}}]}')
    box = readers.dissolved(readers.read_footprints(spark, f"{tmp_path}/f.json")).first()["box"]
    assert tuple(box) == (-1.0, 0.0, 2.0, 3.0)
    path = writers.write_shard(spark.range(3), f"{tmp_path}/cache", "t", "test", 0, 2)
    assert path.endswith("part-00000-of-00002") and spark.read.parquet(path).count() == 3
    tiles = tmp_path / "root/R/HR/s"
    tiles.mkdir(parents=True)
    for i in range(2):
        (tiles / f"{i}.jpg").write_bytes(b"x")
    assert sorted(r["tile"] for r in readers.scan_scene_files(spark, f"{tmp_path}/root").collect()) == [0, 1]


def test_resumable_stream(spark, tmp_path):
    from tessella.streaming import resumable

    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(0, 5).withColumnRenamed("id", "sample_idx").write.parquet(f"{source}/a")
    for n in (5, 8):
        resumable.merge_arriving_shards(spark, f"{source}/*", "sample_idx long", target, f"{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(target).count() == n
        spark.range(5, 8).withColumnRenamed("id", "sample_idx").write.mode("overwrite").parquet(f"{source}/b")
