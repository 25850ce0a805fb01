"""Plans whose cost grew faster than their input, or stood out for it: same results, less work."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.config import Policy
from tessella.operators import models, sampling, selection
from tessella.plans import pipelines
from tessella.streaming import resumable


def test_filled_cells_are_not_shuffled(spark, tmp_path):
    """Repeated cells, nulls, tiles out of range and unknown samples, as a join of all cells has them; but no more rows are shuffled than come in."""
    rng = random.Random(6)
    samples = spark.createDataFrame([(s,) for s in (1, 2, 2, 3, None)], "sample_idx int")
    rows = [(rng.choice([1, 2, 9, None]), rng.choice([-1, 0, 1, 4, 5, 5, 9, 10, None]), rng.choice([0.5, 1.5, None])) for _ in range(60)]
    observed = spark.createDataFrame(rows, "sample_idx long, tile long, value double")
    got = selection.fill_cells(samples, observed, -1.0, cells=10)
    above, *below = got._jdf.queryExecution().executedPlan().toString().split("Exchange")
    assert "Generate" in above and below and "Generate" not in "".join(below)
    frame = samples.distinct().withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(9))))
    want = frame.join(observed, ["sample_idx", "tile"], "left").select("sample_idx", "tile", F.coalesce("value", F.lit(-1.0)).alias("value"), F.col("value").isNotNull().alias("seen"))
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_arriving_shards_keep_no_python_state(spark, tmp_path, monkeypatch):
    """One index is one row of state without a call of Python for each; all columns, null rows' too, arrive, and a null index that comes again is refused."""
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", None)
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda: resumable.merge_arriving_shards(spark, f"{source}/*", "sample_idx long, v string, w double", target, f"{tmp_path}/state", files=1).awaitTermination()
    rows = [[(1, "a", 0.5), (None, None, None)], [(2, None, None), (3, "c", 1.0)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "sample_idx long, v string, w double").coalesce(1).write.parquet(f"{source}/{i}")
    run()
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(f"{target}/batch=*").collect()))) == sorted(str(r) for part in rows for r in part)
    spark.createDataFrame([(None, "again", 2.0)], "sample_idx long, v string, w double").coalesce(1).write.parquet(f"{source}/late")
    with pytest.raises(Exception, match="repeated sample_idx"):
        run()
    assert spark.read.parquet(f"{target}/batch=*").count() == 4


def test_single_query_holds_two_workers_a_task(spark):
    """The router's and that of all other scorers, in batches that bytes bound."""
    rows = spark.createDataFrame([(i, [float(i + t) for t in range(100)], [1.0, 2.0], [0.5, 0.25]) for i in range(3)], "sample_idx int, router array<double>, hr array<double>, lr array<double>")
    column = lambda name: lambda: models.ColumnScorer(name)
    got = pipelines.single_query(rows, column("router"), column("hr"), column("lr"), Policy(("a", "b"), (2, 3)), "b", tiles=column("router"), features=column("lr"))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert all(r["class_scores"] == [1.0 + 0.075 * 0.5, 2.0 + 0.075 * 1.75] and r["tile_scores"] == r["router_scores"] and r["predicted_features"] == [0.5, 0.25] for r in got.collect())


def test_pooled_features_take_components_once(spark):
    """One explosion of components for all raw ways, each the same as alone, and no product with classes that aren't broadcast, whatever their estimated size."""
    rng = random.Random(8)
    features = spark.createDataFrame([(rng.randrange(6), [rng.gauss(0, 1) for _ in range(5)]) for _ in range(40)], "sample_idx int, feature array<double>")
    text = spark.createDataFrame([(c, [rng.gauss(0, 1) for _ in range(5)]) for c in range(3)], "class_id int, proto array<double>")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        together, alone = selection.pool_raw_features(features, text), [selection.pool_features(features, text, m) for m in selection.POOLS]
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (together, *alone)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not any("CartesianProduct" in p for p in plans) and plans[0].count("Generate posexplode") == 1
    got = {(r["sample_idx"], r["class_id"]): r for r in together.collect()}
    for mode, df in zip(selection.POOLS[1:], alone[1:], strict=True):
        rows = df.collect()
        assert len(rows) == len(got) and all(abs(got[r["sample_idx"], r["class_id"]][mode] - r["score"]) < 1e-12 for r in rows)


def test_sample_that_ends_early_draws_no_table(spark, monkeypatch):
    """Regions that end within their first places, beside one that doesn't as it has a rare class; the rule's picks in both, and the table of all draws for the latter only."""
    monkeypatch.setattr(sampling, "FIRST", 64)
    asked, whole = [], sampling.shuffled_places
    monkeypatch.setattr(sampling, "shuffled_places", lambda sizes, seed: asked.extend(r["_group"] for r in sizes.collect()) or whole(sizes, seed))
    rng = random.Random(5)
    rows = [(g, f"p{i}", [rng.randrange(3)] if g != "bare" else [], i) for g in ("a", "b", "bare") for i in range(300)] + [("rare", f"p{i}", [9] if i == 170 else [rng.randrange(3)], i) for i in range(300)]
    got: dict = {}
    for r in sampling.balanced_sample(spark.createDataFrame(rows, "region string, patch_id string, classes array<int>, ord int"), 16, seed=3).collect():
        got.setdefault(r["region"], []).append(r["patch_id"])
    for g in ("a", "b", "bare", "rare"):
        own = [r for r in rows if r[0] == g]
        assert sorted(got[g]) == sorted(sampling.greedy_pick([r[1] for r in own], [r[2] for r in own], 16, 3)), g
    assert asked in ([], ["=rare"])
    places = sampling.first_places(spark.createDataFrame([("x", 257), ("y", 1), ("z", 0)], "_group string, n long"), 40, 5).collect()
    random.Random(5).shuffle(order := list(range(257)))
    assert sorted((r["pos"], r["at"]) for r in places if r["_group"] == "x") == list(enumerate(order[:40])) and len(places) == 41
