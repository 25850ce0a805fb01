"""Every query of the library at the smallest scale, against the same in SQL."""

import pytest
from conftest import SF, comparable

from tessella.plans import pipelines
from tessella.plans import queries as q
from tessella.plans import shape_queries, table_queries  # noqa: F401  they register their queries


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_as_sql(name, spark, duck):
    got, want = q.QUERIES[name](spark, SF).toPandas(), duck.sql(q.ORACLE_SQL[name]).df()
    assert comparable(got) == comparable(want)


def test_samples_hold_their_bounds(spark):
    for name in ("balanced_sample", "hashed_sample"):
        rows = q.QUERIES[name](spark, SF).toPandas()
        sizes = q.order_classes(spark, SF).groupBy("region").count().toPandas().set_index("region")["count"]
        got = rows.groupby("region").patch_id.nunique()
        assert all(got[r] == min(200, sizes[r]) for r in sizes.index), name


def test_index(spark):
    scenes = q.index_scenes(spark, SF).toPandas()
    assert sorted(scenes.patch_id) == list(range(1, len(scenes) + 1))
    for r in scenes.itertuples():
        assert len(r.classes) >= 2 and abs(sum(r.class_fracs.values()) - 1) < 1e-9
        assert sorted(r.class_fracs) == list(r.classes)


def test_tiles_of_all_scenes(spark):
    """Tiles belong to the scenes, and their classes to the polygons that brute force finds in them."""
    scenes, tiles = q.index_scenes(spark, SF).toPandas(), q.index_tiles(spark, SF).toPandas()
    assert len(scenes) > 40 and len(tiles) == 100 * len(scenes) and set(tiles.patch_id) == set(scenes.patch_id)
    features = [([(p["x"], p["y"]) for p in f["rings"][0]], set(f["class_ids"])) for f in pipelines.classified_features(q.polygon_features(spark, SF)).select("rings", "class_ids").collect()]

    def clipped(ring, box):
        for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
            out = []
            for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True):
                da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
                if (da < 0) != (db < 0):
                    out.append(tuple(u + (v - u) * da / (da - db) for u, v in zip(a, b, strict=True)))
                if db >= 0:
                    out.append(b)
            ring = out
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True))) / 2

    by_scene = {s.patch_id: [f for f in features if all(abs(f[0][0][k] - c) < 0.4 for k, c in ((0, s.center_lon), (1, s.center_lat)))] for s in scenes.itertuples()}
    for t in tiles.itertuples():
        areas = [(clipped(ring, (t.tile_min_lon, t.tile_min_lat, t.tile_max_lon, t.tile_max_lat)), ids) for ring, ids in by_scene[t.patch_id]]
        sure, perhaps = ({c for a, ids in areas if a > least for c in ids} for least in (1e-9, 1e-15))
        assert sure <= set(t.tile_class_fracs) <= perhaps, t


def test_fill_cells_of_all_orders(spark):
    cells = {(r["sample_idx"], r["tile"]): r["score"] for r in q.cell_scores(spark, SF).collect()}
    orders = {r[0] for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    got = q.QUERIES["fill_cells"](spark, SF).toPandas()
    want = {(o, t): (cells.get((o, t), -1.0), (o, t) in cells) for o in orders for t in range(100)}
    assert len(got) == len(want) and {(r.sample_idx, r.tile): (r.value, r.seen) for r in got.itertuples()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_model_interface(spark):
    rows = q.model_route(spark, SF).toPandas()
    assert (rows.selected_count == 12).all() and rows.groupby("sample_idx").size().eq(10).all()
