"""Registered queries over sources, sinks and rasters: given tables are written by the library's writers and read back by its readers, or taken as pixels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import codec
from ..operators import rasters, selection, shards
from ..sources import readers, writers
from ..storage import shared_dir
from ..streaming import resumable
from . import pipelines
from .queries import _INDEX, _REACH, SCORES, box_features, polygon_features, prototypes, query, table


def fresh(spark, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_nationkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer")
def csv_scan(spark, sf_dir):
    """Customers written as CSV, and read by name with a header that is checked."""
    path = fresh(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", "c_acctbal"), path)
    rows = readers.read_csv(spark, path, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double", ["c_custkey", "c_acctbal"])
    return rows.select("c_custkey", F.col("c_nationkey").cast(dict(table(spark, sf_dir, "customer").dtypes)["c_nationkey"]).alias("c_nationkey"), "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_idx FROM orders")
def manifest_scan(spark, sf_dir):
    """A manifest of several files; each row has its place in all of them."""
    path = fresh(spark, "manifest")
    writers.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return readers.read_manifest(spark, path, "o_orderkey long, o_orderstatus string", ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "sample_idx")


@query('SELECT l_orderkey, l_linenumber, row_number() OVER () - 1 AS "offset" FROM lineitem')
def batch_offsets(spark, sf_dir):
    """Line items with their place in the Parquet file."""
    rows = readers.read_batches(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber"])
    return readers.running_offset(rows).select("l_orderkey", "l_linenumber", "offset")


@query("SELECT p_type || '_' || p_partkey || '.jpg' AS name, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS target FROM part")
def image_list(spark, sf_dir):
    """A list of file names as text, whose classes are what comes before the underscore."""
    path, parts = fresh(spark, "list"), table(spark, sf_dir, "part")
    parts.select(F.concat("p_type", F.lit("_"), "p_partkey", F.lit(".jpg"))).write.text(path)
    return readers.read_image_list(spark, path, sorted(r[0] for r in parts.select("p_type").distinct().collect()))


@query(f"WITH {SCORES} SELECT sample_idx, class_id, score, target FROM sc")
def shard_files(spark, sf_dir):
    """Scores written as three shards of samples, and read with a check of their format."""
    from .queries import prototype_scores

    root = fresh(spark, "shards")
    rows = prototype_scores(spark, sf_dir).withColumn("format", F.lit("scores-1"))
    for i in range(3):
        writers.write_shard(rows.where(F.col("sample_idx") % 3 == i), root, "transfer", "test", i, 3)
    return readers.read_shards(spark, root, "scores-1").select("sample_idx", "class_id", F.round("score", 9).alias("score"), "target")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS patch_id, c_custkey % 66 || '|' || c_custkey % 7 AS classes,
  (c_custkey % 7) || ':' || printf('%.4f', abs(c_acctbal) / 9999.0::DOUBLE) || '|' || (7 + c_custkey % 11) || ':' || printf('%.4f', c_custkey / 3.0::DOUBLE) AS class_fracs,
  (c_custkey % 7) || ':' || printf('%.8f', abs(c_acctbal) / 7777.0::DOUBLE) AS class_fracs_abs FROM customer""")
def index_files(spark, sf_dir):
    """The scene table of an index in its text form, from one CSV file to another."""
    k, path = F.col("c_custkey"), fresh(spark, "index")
    fractions = F.create_map((k % 7).cast("int"), F.abs("c_acctbal") / F.lit(9999.0), (7 + k % 11).cast("int"), k / F.lit(3.0))
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("patch_id"), *(F.lit(0.0).alias(c) for c in ("center_lat", "center_lon", "sent_min_lat", "sent_min_lon", "sent_max_lat", "sent_max_lon")), F.array(k % 66, k % 7).alias("classes"),
        fractions.alias("class_fracs"), F.create_map((k % 7).cast("int"), F.abs("c_acctbal") / F.lit(7777.0)).alias("class_fracs_abs"))
    writers.write_csv(writers.scene_index_rows(rows), path)
    return readers.read_scene_index(spark, path).select("patch_id", codec.encode_classes(F.col("classes")).alias("classes"), "class_fracs", "class_fracs_abs")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 0")
def published_tables(spark, sf_dir):
    """Two tables published together, and again in another version, which is the one that is read."""
    root = fresh(spark, "published")
    pair = {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")}
    writers.publish_pair(pair, root, "sales")
    writers.publish_pair(pair | {"orders": pair["orders"].where("o_orderkey % 2 = 0")}, root, "sales", overwrite=True)
    held = writers.read_pair(spark, root, "sales")
    return held["orders"].join(held["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("""SELECT c_custkey, 'https://example.org/' || lower(c_mktsegment) || '/' || c_custkey || '.pbf' AS url FROM customer""")
def url_template(spark, sf_dir):
    """Addresses made from a template and columns."""
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", codec.render("https://example.org/{slug}/{region}.pbf", slug=F.lower("c_mktsegment"), region=F.col("c_custkey")).alias("url"))


@query("SELECT c_custkey AS sample_idx, c_acctbal AS score FROM customer")
def arriving_shards(spark, sf_dir):
    """Customers in five files that arrive one by one, appended once each by a stream that knows which have come."""
    source, target = fresh(spark, "arriving"), fresh(spark, "arrived")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_idx"), F.col("c_acctbal").alias("score"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    for i in range(5):
        rows.where(F.col("sample_idx") % 5 == i).coalesce(1).write.parquet(f"{source}/{i}")
    resumable.merge_arriving_shards(spark, f"{source}/*", schema, target, fresh(spark, "state"), files=2).awaitTermination()
    return spark.read.schema(schema).option("basePath", target).parquet(f"{target}/batch=*").select("sample_idx", "score")


@query("""SELECT round(lon - 0.05, 6) AS x0, round(lat - 0.05, 6) AS y0, round(lon + 0.05, 6) AS x1, round(lat + 0.05, 6) AS y1, 8 AS corners FROM (
  SELECT (c_custkey * 37 % 1000) / 100.0::DOUBLE AS lat, (c_custkey * 91 % 1000) / 100.0::DOUBLE AS lon FROM customer)""")
def geojson_scan(spark, sf_dir):
    """Octagons written as collections of GeoJSON features, and read as polygons with their bounds."""
    path = fresh(spark, "geojson")
    corner = lambda p: F.array(p["x"], p["y"])
    rings = polygon_features(spark, sf_dir).select((F.col("feature_id") % 8).alias("file"), F.transform("rings", lambda r: F.transform(r, corner)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), "coordinates").alias("geometry"))
    files = rings.groupBy("file").agg(F.collect_list(feature).alias("features")).select("file", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    files.write.partitionBy("file").text(path)
    held = readers.read_footprints(spark, f"{path}/file=*")
    return held.select(*(F.round(F.col(f"box.{c}"), 6).alias(c) for c in ("x0", "y0", "x1", "y1")), F.size(F.flatten(F.flatten("parts"))).alias("corners"))


@query(f"WITH {_INDEX.replace('ORDER BY c_custkey) = 1)', 'ORDER BY c_custkey) = 1 ORDER BY c_custkey LIMIT 30)', 1)} SELECT patch_id, round(lat, 6) AS lat, round(lon, 6) AS lon, count(*) AS classes FROM fr JOIN id USING (center) JOIN pa USING (center) GROUP BY ALL")
def index_limited(spark, sf_dir):
    """Scenes of an index of squares that is made of the first thirty centres."""
    foot = spark.createDataFrame([((0.5, 0.0, 9.4, 9.9),)], "box struct<x0:double,y0:double,x1:double,y1:double>")
    scenes = pipelines.build_index(box_features(spark, sf_dir), "all", foot, halfwidth=_REACH / 10, spacing=0.5, limit=30, invalid="keep")[0]
    return scenes.select("patch_id", F.round("center_lat", 6).alias("lat"), F.round("center_lon", 6).alias("lon"), F.size("classes").cast("long").alias("classes"))


@query("SELECT p_partkey, '/data/' || p_type || '/LR/' || p_partkey || '.jpg' AS moved, p_type || '/HR/' || p_partkey || '/' || p_size || '.jpg' AS tile FROM part")
def scene_paths(spark, sf_dir):
    """Paths of scenes under another root, and of their tiles."""
    path = F.concat(F.lit("/old/place/"), F.col("p_type"), F.lit("/LR/"), F.col("p_partkey"), F.lit(".jpg"))
    return table(spark, sf_dir, "part").select("p_partkey", codec.under_root("/data", path).alias("moved"), codec.tile_path(path, F.col("p_size")).alias("tile"))


@query("SELECT l_orderkey % 4 AS shard, count(*) AS rows, 'A,N,R' AS vocabulary FROM lineitem GROUP BY ALL")
def shard_vocabulary(spark, sf_dir):
    """Shards of line items and the flags that occur in them, which all shards have to have alike."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 4).alias("shard")).agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("vocabulary"))
    return shards.require_agreement(rows, ["vocabulary"])


@query(f"""WITH {SCORES}, n AS (SELECT vec_id AS sample_idx, row_number() OVER (ORDER BY vec_id DESC) - 1 AS place FROM embeddings)
  SELECT name, place AS sample_idx, class_id, 'class ' || class_id AS class_name, round(CAST(CAST(CASE name WHEN 'high' THEN score ELSE score / 2 END AS REAL) AS DOUBLE), 5) AS score, target
  FROM sc JOIN n USING (sample_idx), (SELECT unnest(['high', 'low']) AS name)""")
def transfer_payload(spark, sf_dir):
    """Two kinds of scores of all vectors as transfer predictions, numbered in the order in which they were scored: from the last vector to the first."""
    from .queries import prototype_scores

    scores = prototype_scores(spark, sf_dir).withColumn("ord", -F.col("sample_idx"))
    targets = table(spark, sf_dir, "embeddings").select((-F.col("vec_id")).alias("ord"), F.col("label").alias("class_id"))
    both = {"high": scores, "low": scores.withColumn("score", F.col("score") / 2)}
    found = pipelines.prediction_payload(both, targets, tuple(f"class {i}" for i in range(10)), "vectors", pipelines.TASKS[0], "predictions-1")
    return found.select("name", "sample_idx", "class_id", "class_name", F.round(F.col("score").cast("double"), 5).alias("score"), "target")


def _weights(name: str, n: int, out: int) -> str:
    """SQL of the cubic filter's weights from n to out pixels."""
    scale, wide = n / out, max(n / out, 1.0)
    x = f"abs((a - (t + 0.5) * {scale}::DOUBLE + 0.5) / {wide}::DOUBLE)"
    w = f"CASE WHEN {x} < 1 THEN 1.5 * {x} ** 3 - 2.5 * {x} ** 2 + 1 WHEN {x} < 2 THEN -0.5 * {x} ** 3 + 2.5 * {x} ** 2 - 4 * {x} + 2 ELSE 0 END"
    near = f"a >= floor((t + 0.5) * {scale}::DOUBLE - {2 * wide}::DOUBLE + 0.5) AND a < floor((t + 0.5) * {scale}::DOUBLE + {2 * wide}::DOUBLE + 0.5)"
    return f"{name} AS (SELECT t, a, w / sum(w) OVER (PARTITION BY t) AS w FROM (SELECT t, a, CAST({w} AS DOUBLE) AS w FROM range(0, {out}) x(t), range(0, {n}) y(a) WHERE {near}))"


@query(f"""WITH p AS (SELECT vec_id, (unnest(range(0, 64)) // 8) AS y, (unnest(range(0, 64)) % 8) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), {_weights("wx", 8, 5)}, {_weights("wy", 8, 13)},
  h AS (SELECT vec_id, y, wx.t AS x, sum(v * w) AS v FROM p JOIN wx ON wx.a = p.x GROUP BY ALL)
  SELECT vec_id, CAST(wy.t AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sum(v * w), 6) AS value FROM h JOIN wy ON wy.a = h.y GROUP BY ALL""")
def resize_vectors(spark, sf_dir):
    """Vectors as images of 8 x 8 pixels, made narrower and higher by the cubic filter."""
    pixels = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("v").cast("double").alias("value"))
    return rasters.resized(pixels, 5, 13, keys=("vec_id",)).select("vec_id", "y", "x", F.round("value", 6).alias("value"))


@query("""WITH p AS (SELECT vec_id // 64 AS mosaic, vec_id % 64 AS y, unnest(range(0, 64)) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
  s AS (SELECT mosaic, (max(y) + 1) // 10 AS h FROM p GROUP BY mosaic)
  SELECT mosaic, CAST(y // h * 10 + x // 6 AS INTEGER) AS tile, count(*) AS n, round(sum(v), 6) AS total, round(max(CASE WHEN y % h = 0 AND x % 6 = 0 THEN v END), 6) AS corner
  FROM p JOIN s USING (mosaic) WHERE h > 0 AND x < 60 AND y < h * 10 GROUP BY ALL""")
def mosaic_cells(spark, sf_dir):
    """Every 64 vectors as the rows of a mosaic, which is cut into 100 tiles."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("mosaic"), (F.col("vec_id") % 64).alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))
    flat = F.flatten("pixels")
    return rasters.mosaic_tiles(rows).select("mosaic", "tile", F.size(flat).cast("long").alias("n"), F.round(F.aggregate(flat, F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.round(F.get(flat, F.lit(0)), 6).alias("corner"))


@query(f"""WITH {SCORES}, g AS (SELECT vec_id // 5 AS sample_idx, i, avg(v) AS mean, (avg(v) + max(v)) / 2 AS both_, max(v) AS mx FROM e GROUP BY ALL),
  t AS (SELECT label AS class_id, i, avg(v) AS m FROM e GROUP BY ALL), tn AS (SELECT class_id, sqrt(sum(m * m)) AS n FROM t GROUP BY ALL),
  d AS (SELECT sample_idx, class_id, sum(mean * m) / sqrt(sum(mean * mean)) AS mean, sum(mx * m) / sqrt(sum(mx * mx)) AS mx, sum(both_ * m) / sqrt(sum(both_ * both_)) AS both_ FROM g JOIN t USING (i) GROUP BY ALL),
  q AS (SELECT vec_id // 5 AS sample_idx, class_id, max(s) AS best FROM (SELECT vec_id, class_id, sum(v * m) / sqrt(sum(v * v)) AS s FROM e JOIN t USING (i) GROUP BY ALL) GROUP BY ALL)
  SELECT sample_idx, class_id, round(best / n, 6) AS patch_score_max, round(mx / n, 6) AS raw_feature_max, round(mean / n, 6) AS raw_feature_mean, round(both_ / n, 6) AS raw_feature_mean_max
  FROM d JOIN q USING (sample_idx, class_id) JOIN tn USING (class_id)""")
def pool_named(spark, sf_dir):
    """Samples of five vectors against class vectors, by all four ways to pool."""
    e = table(spark, sf_dir, "embeddings")
    cells, text = e.select(F.floor(F.col("vec_id") / 5).alias("sample_idx"), F.col("embedding").alias("feature")), prototypes(e)
    keys = ["sample_idx", "class_id"]
    best = selection.pool_features(cells, text, "patch_score_max").withColumnRenamed("score", "patch_score_max")
    return best.join(selection.pool_raw_features(cells, text), keys).select(*keys, *(F.round(m, 6).alias(m) for m in selection.POOLS))
