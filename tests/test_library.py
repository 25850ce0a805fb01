"""Stages, sources and hot spots of the library against brute force and hand-made cases."""

import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessella import cli, storage
from tessella.config import EvaluationConfig
from tessella.operators import imagery, metrics, sampling, spatial, splits
from tessella.plans import pipelines
from tessella.sources import readers, writers
from tessella.streaming import resumable

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def boxes(spark, rows, box="box", name="id"):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"{name} long, {box} {BOX}")


def test_overlap_join_of_all_sizes(spark):
    """From points to one box as large as the world, and empty tables."""
    rng = random.Random(1)

    def some(n):
        out = []
        for _ in range(n):
            x, y, w = rng.uniform(-180, 170), rng.uniform(-90, 80), 10 ** rng.uniform(-3, 2)
            out.append((x, y, x + w, y + w * rng.uniform(0.1, 1)))
        return out

    a, b = [*some(120), (-180.0, -90.0, 180.0, 90.0)], [*some(150), (-180.0, -90.0, 180.0, 90.0), (1.0, 1.0, 1.0, 1.0)]
    got = spatial.overlap_join(boxes(spark, a), boxes(spark, b, "rbox", "rid"), 0.024).select("id", "rid", "overlap").collect()
    area = lambda p, q: max(min(p[2], q[2]) - max(p[0], q[0]), 0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0)
    want = {(i, j): area(p, q) for i, p in enumerate(a) for j, q in enumerate(b) if area(p, q) > 0}
    assert len(got) == len(want) and all(abs(want[r["id"], r["rid"]] - r["overlap"]) < 1e-9 for r in got)
    assert spatial.overlap_join(boxes(spark, []), boxes(spark, b, "rbox", "rid"), 0.024).count() == 0


def test_union_area_of_many_boxes(spark):
    rng = random.Random(2)
    rows = [(k, (x, y, x + rng.randint(0, 9), y + rng.randint(0, 9))) for k in ("a", None) for x, y in ((rng.randint(0, 40), rng.randint(0, 40)) for _ in range(150))]
    df = spark.createDataFrame([(k, tuple(map(float, b))) for k, b in rows], f"key string, box {BOX}")
    got = {r["key"]: r["covered"] for r in spatial.box_union_area(df, "key", "box").collect()}
    for key in ("a", None):
        cells = {(x, y) for k, b in rows if k == key for x in range(b[0], b[2]) for y in range(b[1], b[3])}
        assert abs(got[key] - len(cells)) < 1e-6


def test_average_precision_in_ranges(spark):
    """Scores that lie close together, and scores of all magnitudes, in one class and in several."""
    rng = random.Random(3)
    rows = [(i, c, s, rng.randint(0, 1)) for c in range(3) for i, s in enumerate([0.25 + rng.randrange(40) * 1e-7 for _ in range(80)] + [rng.choice((-1, 1)) * 10 ** rng.uniform(-9, 9) for _ in range(40)])]

    def plain(part):
        total, seen, hits = 0.0, 0, 0
        for s in sorted({r[2] for r in part}, reverse=True):
            p = sum(r[3] for r in part if r[2] == s)
            seen, hits = seen + sum(r[2] == s for r in part), hits + p
            total += p * hits / seen
        return total / hits

    df = spark.createDataFrame(rows, "sample_idx long, class_id int, score double, target int")
    got = {r["class_id"]: r["ap"] for r in metrics.average_precision(df).collect()}
    assert all(abs(got[c] - plain([r for r in rows if r[1] == c])) < 1e-12 for c in range(3))
    assert abs(metrics.micro_average_precision(df).first()["micro"] - plain(rows)) < 1e-12


def test_balanced_sample_equals_its_rule(spark):
    rng = random.Random(4)
    rows = [(r, f"p{i}", [rng.randrange(6) for _ in range(rng.randrange(3))], i) for r in ("a", "b") for i in range(60)]
    got = sampling.balanced_sample(spark.createDataFrame(rows, "region string, patch_id string, classes array<int>, ord int"), 20, seed=9).collect()
    for region in ("a", "b"):
        mine = [r for r in rows if r[0] == region]
        random.Random(9).shuffle(order := list(range(len(mine))))
        kinds = {c for r in mine for c in r[2]}
        taken, counts = [], dict.fromkeys(kinds, 0)
        for need in (True, False):
            for i in order:
                if len(taken) < 20 and mine[i][1] not in taken and (not need or any(counts[c] < 20 / len(kinds) for c in mine[i][2])):
                    taken.append(mine[i][1])
                    for c in mine[i][2] if need else ():
                        counts[c] += 1
        assert sorted(taken) == sorted(r["patch_id"] for r in got if r["region"] == region)


def test_scenes_that_are_not_whole_are_refused(spark):
    files = lambda rows: spark.createDataFrame(rows, "region string, scene string, tile int")
    whole = [("R", "00001_1.0_2.0_3", t) for t in range(3)]
    assert splits.complete_scenes(files(whole), 3).first()["labels"] == [3]
    for bad in ([*whole, ("R", "00002_1.0_2.0_3", 0)], [*whole, *(("R", "no_name", t) for t in range(3))]):
        with pytest.raises(ValueError, match="scenes"):
            splits.complete_scenes(files(bad), 3)
        assert splits.complete_scenes(files(bad), 3, incomplete="drop").count() == 1
    images = spark.createDataFrame([("R", "00001_1.0_2.0_3"), ("R", "00009_1.0_2.0_3")], "region string, scene string")
    with pytest.raises(ValueError, match="00009"):
        splits.complete_scenes(files(whole), 3, images)


def test_footprints_are_one_box(spark):
    with pytest.raises(ValueError, match="one box"):
        pipelines.one_box(boxes(spark, [(0.0, 0.0, 1.0, 1.0), (1.0, 1.0, 2.0, 2.0)]))
    assert pipelines.one_box(None) is None


def test_manifest_places_and_offsets(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for name, ids in (("b.csv", range(100, 130)), ("a.csv", range(0, 70))):
        (tmp_path / "m" / name).write_text("id,filepath\n" + "".join(f"{i},R/LR/{i}.jpg\n" for i in ids))
    rows = readers.read_manifest(spark, f"{tmp_path}/m", "id long, filepath string", ["id"]).orderBy("sample_idx").collect()
    assert [r["sample_idx"] for r in rows] == list(range(100)) and [r["id"] for r in rows] == [*range(0, 70), *range(100, 130)]
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/p/a")
    spark.range(50, 80).coalesce(1).write.parquet(f"{tmp_path}/p/b")
    placed = readers.running_offset(readers.read_batches(spark, [f"{tmp_path}/p/a", f"{tmp_path}/p/b"], ["id"])).collect()
    assert all(r["offset"] == r["id"] for r in placed) and len(placed) == 80


def test_only_selected_tiles_are_read(spark, tmp_path):
    for t in range(4):
        (tmp_path / "R/HR/s").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"R/HR/s/{t}.jpg").write_bytes(bytes([t]))
    (tmp_path / "R/LR").mkdir()
    (tmp_path / "R/LR/s.jpg").write_bytes(b"x")
    assert [tuple(r) for r in readers.scan_scene_images(spark, f"{tmp_path}").collect()] == [("R", "s", "R/LR/s.jpg")]
    pick = lambda *t: spark.createDataFrame([("R", "s", x) for x in t], "region string, scene string, tile int")
    got = readers.read_tiles(spark, f"{tmp_path}", pick(3, 1)).collect()
    assert sorted((r["tile"], bytes(r["content"])) for r in got) == [(1, b"\x01"), (3, b"\x03")]
    for bad in (pick(1, 1), pick(9)):
        with pytest.raises(ValueError):
            readers.read_tiles(spark, f"{tmp_path}", bad)


def test_pairs_are_published_at_once(spark, tmp_path):
    one = {"hr": spark.range(3), "lr": spark.range(2)}
    first = writers.publish_pair(one, f"{tmp_path}", "R")
    with pytest.raises(ValueError, match="exists"):
        writers.publish_pair(one, f"{tmp_path}", "R")
    broken = {"hr": spark.range(9), "lr": spark.range(1).select(F.raise_error(F.lit("lost")).alias("id"))}
    with pytest.raises(Exception, match="lost"):
        writers.publish_pair(broken, f"{tmp_path}", "R", overwrite=True)
    assert {k: df.count() for k, df in writers.read_pair(spark, f"{tmp_path}", "R").items()} == {"hr": 3, "lr": 2}
    assert writers.publish_pair({"hr": spark.range(5), "lr": spark.range(4)}, f"{tmp_path}", "R", overwrite=True) != first
    assert {k: df.count() for k, df in writers.read_pair(spark, f"{tmp_path}", "R").items()} == {"hr": 5, "lr": 4}
    assert writers.write_counted(spark.range(7), f"{tmp_path}/csv") == 7


def test_shards_that_arrive_twice(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda: resumable.merge_arriving_shards(spark, f"{source}/*", "sample_idx long", target, f"{tmp_path}/state").awaitTermination()
    spark.range(0, 5).withColumnRenamed("id", "sample_idx").write.parquet(f"{source}/a")
    run()
    spark.range(4, 8).withColumnRenamed("id", "sample_idx").write.parquet(f"{source}/b")
    with pytest.raises(Exception, match="repeated sample_idx"):
        run()
    assert spark.read.parquet(target).count() == 5


def test_a_shard_that_comes_again_three_batches_later(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda: resumable.merge_arriving_shards(spark, f"{source}/*", "sample_idx long, v string", target, f"{tmp_path}/state", files=1).awaitTermination()
    for i in range(4):
        spark.range(10 * i, 10 * i + 10).selectExpr("id AS sample_idx", "'x' AS v").coalesce(1).write.parquet(f"{source}/{i}")
        run()
    assert spark.read.parquet(target).count() == 40
    spark.range(3, 4).selectExpr("id AS sample_idx", "'again' AS v").write.parquet(f"{source}/late")
    with pytest.raises(Exception, match="repeated sample_idx"):
        run()
    assert spark.read.parquet(target).where("v = 'again'").count() == 0


def test_image_arithmetic(spark):
    pixels = F.array(F.array(F.lit(0), F.lit(255)), F.array(F.lit(51), F.lit(102)))
    got = spark.range(1).select(imagery.normalised_pixels(pixels, [0.5, 0.5], [0.25, 0.5]).alias("x")).first()["x"]
    assert [[round(v, 9) for v in p] for p in got] == [[-2.0, 1.0], [-1.2, -0.2]]
    grid = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))
    got = spark.range(1).select(imagery.padded_rows(grid, 5).alias("x")).first()["x"]
    assert got == [[0, 0, 0, 0, 0], [0, 1, 2, 0, 0], [0, 3, 4, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]
    done = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, imagery.replace_pairs(done, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_clusters_need_a_shared_folder():
    def session(master, folder=None):
        held = SimpleNamespace(isDefined=lambda: False)
        context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)), master=master, setCheckpointDir=lambda p: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: folder))

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master))
        assert storage.shared_dir(session(master, "hdfs://x/y")) == "hdfs://x/y"
    assert storage.shared_dir(session("local[4]")).startswith("file://")


def test_evaluation_config(tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs/e.yaml").write_text("classes: [a, b]\ntask: retrieval\npaths: {cache: out/cache, other: /x/y}\nfusion: {input_group: a, output_group: b, weight: 0.5}\n")
    c = EvaluationConfig.load(tmp_path / "configs/e.yaml")
    assert c.path("cache") == tmp_path.resolve() / "out/cache" and str(c.path("other")) == "/x/y" and c.fusion.weight == 0.5 and c.topk == 12
    for bad in ({"classes": ["a"]}, {"classes": ["a", "a"], "task": "retrieval"}, {"classes": ["a"], "task": "none"}, {"classes": ["a"], "task": "retrieval", "topk": 101}):
        with pytest.raises(ValueError):
            EvaluationConfig.of(bad, root=tmp_path)


def test_commands(spark, tmp_path):
    from tessella.plans import queries as q

    sf = "/root/testdata/sf0.001"
    q.box_features(spark, sf).withColumn("rings", F.get("parts", F.lit(0))).write.parquet(f"{tmp_path}/features")
    index = ["index", "--features", f"{tmp_path}/features", "--region", "R", "--halfwidth", "0.012", "--spacing", "0.5", "--output", f"{tmp_path}/index"]
    plan = cli.main([*index, "--dry-run"], spark)
    assert plan["status"] == "planned" and plan["outputs"] == [f"{tmp_path}/index"] and not (tmp_path / "index").exists()
    done = cli.main(index, spark)
    assert done["scenes"] > 10 and done["tiles"] == 100 * done["scenes"]
    sampled = cli.main(["sample", "--index", f"{tmp_path}/index", "--region", "R", "--most", "7", "--output", f"{tmp_path}/sampled", "--hashed"], spark)
    assert sampled["scenes"] == 7 and sampled["tiles"] == 700
    with pytest.raises(ValueError, match="exists"):
        cli.main(index, spark)

    for r, first in (("AFRICA", 1), ("EUROPE", 3)):
        for s in (f"{first:05d}_1.0_2.0_3", f"{first + 1:05d}_1.0_2.0_4_5"):
            (tmp_path / f"images/{r}/HR/{s}").mkdir(parents=True)
            (tmp_path / f"images/{r}/LR").mkdir(exist_ok=True)
            (tmp_path / f"images/{r}/LR/{s}.jpg").write_bytes(b"x")
            for t in range(2):
                (tmp_path / f"images/{r}/HR/{s}/{t}.jpg").write_bytes(b"x")
    (tmp_path / "profile.yaml").write_text(json.dumps(q.PROFILE))
    split = cli.main(["split", "--profile", f"{tmp_path}/profile.yaml", "--root", f"{tmp_path}/images", "--tiles", "2", "--output", f"{tmp_path}/split"], spark)
    assert split["rows"] == {"train": 2, "valid": 2}

    for name in ("train", "valid"):
        spark.createDataFrame([(1, 0.0, 0.0, f"{name}/LR/s.jpg", [1])], "id int, lat double, lon double, filepath string, labels array<int>").write.parquet(f"{tmp_path}/m/{name}")
    assert cli.main(["expand", "--manifest", f"train={tmp_path}/m/train", "--manifest", f"valid={tmp_path}/m/valid", "--output", f"{tmp_path}/grouped", "--tiles", "2"], spark)["rows"] == {"train": 1, "valid": 1}

    parts, n = q.score_shards(spark, sf)
    for i, part in enumerate(parts):
        writers.write_shard(part, f"{tmp_path}/cache", "t", "test", i, 3)
    shards = [x for p in sorted((tmp_path / "cache/task=t/split=test").iterdir()) for x in ("--shard", str(p))]
    report = cli.main(["evaluate", *shards, "--task", "single-label", "--samples", str(n), "--output", f"{tmp_path}/report.json"], spark)
    assert report["metrics"][0]["samples"] == n and json.loads((tmp_path / "report.json").read_text())["task"] == "single-label"
    with pytest.raises(ValueError, match="cover"):
        cli.main(["evaluate", *shards[:2], "--task", "single-label", "--samples", str(n)], spark)


def test_score_shards_of_another_format(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 1.0, 1, "v1")], "sample_idx long, class_id int, score double, target int, format string")
    rows.write.parquet(f"{tmp_path}/s")
    assert readers.read_shards(spark, f"{tmp_path}/s", "v1").count() == 1
    with pytest.raises(ValueError, match="v2"):
        readers.read_shards(spark, f"{tmp_path}/s", "v2")
