"""Readers with explicit schemas. Spark opens all paths, so they may be in any store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..storage import staged

# Columns of the two tables of an index, in the order of their files (fixed values).
SCENE_INDEX = "patch_id string, center_lat double, center_lon double, sent_min_lat double, sent_min_lon double, sent_max_lat double, sent_max_lon double, classes string, class_fracs string, class_fracs_abs string"
TILE_INDEX = "patch_id string, tile_row int, tile_col int, tile_index int, tile_min_lat double, tile_min_lon double, tile_max_lat double, tile_max_lon double, tile_class int, tile_class_fracs string"


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A CSV with a header, its columns taken by name; a header without the required ones is an error. With ord: the order of rows within the file."""
    names = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"columns are missing: {missing}")
    types = dict(f.split() for f in (x.strip() for x in schema.split(",")))
    by_file = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    return spark.read.schema(by_file).option("header", True).option("enforceSchema", False).csv(path).withColumn("ord", F.monotonically_increasing_id())


def read_manifest(spark: SparkSession, path: str, schema: str, required: list[str], out: str = "sample_idx") -> DataFrame:
    """A manifest with out: 0, 1, ... without gaps, the place of each row; several files follow each other by name.

    Rows are fixed in the shared folder first. What precedes a block of a file is one number for each block; no row is moved.
    """
    block = ["_metadata.file_path", "_metadata.file_block_start"]
    rows = read_csv(spark, path, schema, required).select("*", *(F.col(c).alias(f"_{i}") for i, c in enumerate(block)))
    rows = staged(spark, rows, "manifest")
    # ord counts the rows of a block one by one.
    blocks = rows.groupBy("_0", "_1").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_0", "_1").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_0", "_1", (before - F.col("first")).alias("_shift"))
    return rows.join(blocks, ["_0", "_1"]).withColumn(out, (F.col("ord") + F.col("_shift")).cast("long")).drop("_0", "_1", "_shift", "ord")


def read_scene_index(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, SCENE_INDEX, ["patch_id", "classes"])
    return rows.withColumn("classes", codec.parse_classes(F.col("classes")))


def read_tile_index(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, TILE_INDEX, ["patch_id", "tile_index"])
    return rows.withColumn("tile_class_fracs", codec.parse_fractions(F.col("tile_class_fracs"))) if "tile_class_fracs" in rows.columns else rows


def all_classes(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("classes").alias("class_id")).distinct()


def scan_scene_files(spark: SparkSession, root: str) -> DataFrame:
    """(region, scene, tile) of root/REGION/HR/scene/tile.jpg; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(root).select("path")
    p = F.split("path", "/")
    n = F.size(p)
    found = files.where(F.get(p, n - 3) == "HR").select(F.get(p, n - 4).alias("region"), F.get(p, n - 2).alias("scene"), F.regexp_extract(F.get(p, n - 1), r"^(\d+)\.jpg$", 1).alias("t"))
    return found.where("t <> ''").select("region", "scene", F.col("t").cast("int").alias("tile"))


def scan_scene_images(spark: SparkSession, root: str) -> DataFrame:
    """(region, scene, file) of root/REGION/LR/scene.jpg; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(root).select("path")
    p = F.split("path", "/")
    n = F.size(p)
    found = files.where(F.get(p, n - 2) == "LR").select(F.get(p, n - 3).alias("region"), F.get(p, n - 1).alias("name"))
    return found.select("region", F.regexp_replace("name", r"[.]jpg$", "").alias("scene"), F.concat_ws("/", "region", F.lit("LR"), "name").alias("file"))


def read_tiles(spark: SparkSession, root: str, selected: DataFrame) -> DataFrame:
    """(region, scene, tile, content) of the tiles that are selected (region, scene, tile), and of no others: files are listed without contents, which are only read for what the join leaves.

    A tile that is selected twice, or isn't there, is an error.
    """
    twice = selected.groupBy("region", "scene", "tile").agg(F.count("*").alias("c")).where("c > 1").limit(5).collect()
    if twice:
        raise ValueError(f"tiles are selected twice: {[tuple(r)[:3] for r in twice]}")
    wanted = selected.join(scan_scene_files(spark, root), ["region", "scene", "tile"], "left_anti").limit(5).collect()
    if wanted:
        raise ValueError(f"tiles aren't there: {[(r['region'], r['scene'], r['tile']) for r in wanted]}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(root)
    p = F.split("path", "/")
    n = F.size(p)
    keyed = files.where(F.get(p, n - 3) == "HR").select(F.get(p, n - 4).alias("region"), F.get(p, n - 2).alias("scene"), F.regexp_extract(F.get(p, n - 1), r"^(\d+)\.jpg$", 1).try_cast("int").alias("tile"), "content")
    return keyed.join(selected.select("region", "scene", "tile"), ["region", "scene", "tile"], "left_semi")


def read_batches(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """Two or more columns of Parquet files, with file and row_index: a position that doesn't depend on how files are split."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))


def running_offset(batches: DataFrame, out: str = "offset") -> DataFrame:
    """batches (see read_batches) with out: the place of each row in all files, one after the other by name. Files are few beside rows; their counts are added up in one task and broadcast, so that no task gets all rows of a file."""
    counts = batches.groupBy("file").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return batches.join(F.broadcast(counts.select("file", before.alias("_before"))), "file").withColumn(out, F.col("_before") + F.col("row_index")).drop("_before")


def read_image_list(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """(name, target) of a list of file names whose class is what precedes the first underscore; another class is an error."""
    table = F.create_map(*(x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))))
    lines = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")
    target = F.try_element_at(table, F.split_part("name", F.lit("_"), F.lit(1)))
    return lines.select("name", F.coalesce(target, F.raise_error(F.concat(F.lit("unknown class in "), "name")).cast("int")).alias("target"))


def read_footprints(spark: SparkSession, path: str) -> DataFrame:
    """(parts, box) of each geometry of GeoJSON files: a FeatureCollection, a Feature, or a bare geometry; polygons, multipolygons, and collections of these, as an array of polygons and as bounds.

    A polygon is an array of rings of corners struct<x,y>, the outer ring first. Other kinds of geometry have no area and are left out.
    """
    inner = "type:string,coordinates:string"
    geometry = f"struct<{inner},geometries:array<struct<{inner}>>>"
    raw = spark.read.text(path, wholetext=True)
    j = raw.select(F.from_json("value", f"type string, coordinates string, geometries array<struct<{inner}>>, geometry {geometry}, features array<struct<geometry:{geometry}>>").alias("j"))
    bare = F.array(F.struct(F.col("j.type").alias("type"), F.col("j.coordinates").alias("coordinates"), F.col("j.geometries").alias("geometries")))
    every = F.when(F.col("j.features").isNotNull(), F.transform("j.features", lambda f: f["geometry"])).when(F.col("j.geometry").isNotNull(), F.array("j.geometry")).otherwise(bare)
    each = j.select(F.explode(every).alias("g")).where("g IS NOT NULL").select(F.explode(F.coalesce("g.geometries", F.array(F.struct("g.type", "g.coordinates")))).alias("g"))
    polygon = F.array(F.from_json("g.coordinates", "array<array<array<double>>>"))
    several = F.from_json("g.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("g.type") == "Polygon", polygon).when(F.col("g.type") == "MultiPolygon", several)
    corner = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    shapes = each.select(F.transform(parts, lambda rings: F.transform(rings, lambda r: F.transform(r, corner))).alias("parts")).where("size(flatten(flatten(parts))) > 0")
    at = lambda c: F.transform(F.flatten(F.flatten("parts")), lambda p: p[c])
    return shapes.select("parts", F.struct(F.array_min(at("x")).alias("x0"), F.array_min(at("y")).alias("y0"), F.array_max(at("x")).alias("x1"), F.array_max(at("y")).alias("y1")).alias("box"))


def dissolved(footprints: DataFrame) -> DataFrame:
    """One row with the bounds of all footprints; none where there are none."""
    b = F.col("box")
    one = footprints.agg(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))
    return one.where("x0 IS NOT NULL").select(F.struct("x0", "y0", "x1", "y1").alias("box"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Tagged area features from Parquet: feature_id, ord, tags, rings, lat, lon. Decoding of map extracts is left to whatever writes that table."""
    return require_columns(spark.read.parquet(path), ["feature_id", "ord", "tags", "rings"])


def read_shards(spark: SparkSession, path: str, format_tag: str | None = None) -> DataFrame:
    """Score shards: shard, sample_idx, class_id, score, target, ... With format_tag, each row's column format has to say so."""
    rows = require_columns(spark.read.parquet(path), ["sample_idx", "class_id", "score", "target", *(["format"] if format_tag else [])])
    if format_tag and not rows.where(~F.col("format").eqNullSafe(F.lit(format_tag))).isEmpty():
        raise ValueError(f"{path} holds rows that aren't {format_tag}")
    return rows


def download_plan(spark: SparkSession, regions: list[tuple[str, str]], template: str, done: DataFrame | None = None) -> DataFrame:
    """(region, slug, url) of what isn't done yet; fetching is not part of this library."""
    plan = spark.createDataFrame(regions, "region string, slug string")
    plan = plan.withColumn("url", codec.render(template, slug=F.col("slug"), region=F.col("region")))
    return plan if done is None else plan.join(done.select("region").distinct(), "region", "left_anti")
