"""Tables in which many rows have the same place: what meets is found once for a place, and results are those of every row."""

import pytest
from conftest import SF, comparable
from pyspark.sql import functions as F

from tessella.operators import spatial
from tessella.plans import pipelines
from tessella.plans import queries as q
from tessella.plans import shape_queries as sq

TIMES = 4


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """The smallest tables, repeated with keys shifted by a multiple of what places and classes go by."""
    out = tmp_path_factory.mktemp("copied")
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        rows.crossJoin(spark.range(TIMES)).withColumn(key, F.col(key) + F.col("id") * 15000).drop("id").write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.fixture(scope="module")
def copied_duck(copied):
    import duckdb

    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{copied}/{name}.parquet/*.parquet'")
    return con


def met(spark, monkeypatch, name, folder):
    """(result, pairs of boxes that met) of a query."""
    seen, box_pairs = [], spatial.box_pairs

    def counted(*args, **kwargs):
        pairs = box_pairs(*args, **kwargs)
        seen.append(pairs.count())
        return pairs

    with monkeypatch.context() as m:
        m.setattr(spatial, "box_pairs", counted)
        return q.QUERIES[name](spark, folder).toPandas(), sum(seen)


@pytest.mark.parametrize("name", ["coverage_area", "coverage_union", "tile_dominant", "patch_class_area", "overlap_join", "index_boxes", "index_box_tiles", "index_scene_classes", "index_tile_classes", "index_coverage"])
def test_copies_meet_once(spark, monkeypatch, copied, copied_duck, name):
    got, pairs = met(spark, monkeypatch, name, copied)
    assert comparable(got) == comparable(copied_duck.sql(q.ORACLE_SQL[name]).df())
    assert 0 < pairs == met(spark, monkeypatch, name, SF)[1]


def test_pairs_are_spread_over_tasks(spark, monkeypatch):
    """Two rows of each side's one box a block, and few pairs a task: every pair comes once, from several tasks."""
    monkeypatch.setattr(spatial, "BLOCK", 2)
    monkeypatch.setattr(spatial, "TASK_PAIRS", 50)
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    one, two = spark.range(30).select(F.col("id").alias("i"), box.alias("box")), spark.range(20).select(F.col("id").alias("j"), box.alias("rbox"))
    got = spatial.overlap_join(one, two, 1.0).select("i", "j", F.spark_partition_id().alias("p")).collect()
    assert len(got) == 600 and {(r["i"], r["j"]) for r in got} == {(i, j) for i in range(30) for j in range(20)} and len({r["p"] for r in got}) > 4


def test_a_shape_is_taken_to_edges_once(spark, monkeypatch, copied):
    """Edges, and so pairs of edges that are tested, don't grow with copies; every feature is found."""
    features, edges = pipelines.feature_edges(q.box_features(spark, copied))
    few, same = pipelines.feature_edges(q.box_features(spark, SF))
    assert features.count() == TIMES * few.count() and edges.count() == same.count()


def test_validity_of_a_shape_that_is_repeated_elsewhere(spark, copied):
    got = {r["c_custkey"]: r["valid"] for r in sq.shape_validity(spark, copied).collect()}
    want = {r["c_custkey"]: r["valid"] for r in sq.shape_validity(spark, SF).collect()}
    assert len(got) == TIMES * len(want) and all(got[k + 15000 * i] == v for k, v in want.items() for i in (0, TIMES - 1))


def test_classes_are_cut_to_the_bound_before_they_are_sorted(spark):
    """The plan limits both windows of a sample, the one by class and the one by region, in the tasks that read."""
    plan = q.hashed_sample(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_rows_of_a_file_stay_where_they_are_read(spark):
    """Places are counted from few rows; line items themselves aren't shuffled by their file, whatever the threshold of broadcasts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q.QUERIES["batch_offsets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
