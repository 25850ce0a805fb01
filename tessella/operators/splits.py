"""Region-disjoint splits, scene scans, label histograms and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec


def assign_split(rows: DataFrame, regions: dict[str, list[str]], region: str = "region") -> DataFrame:
    """rows with the split of their region; rows of other regions are left out. A region in two splits is an error."""
    named = [r for rs in regions.values() for r in rs]
    if len(named) != len(set(named)):
        raise ValueError("a region belongs to two splits")
    split = None
    for name, rs in regions.items():
        hit = F.col(region).isin(rs)
        split = F.when(hit, name) if split is None else split.when(hit, name)
    return rows.withColumn("split", split).where("split IS NOT NULL")


def conflicts(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, splits): keys that are in more than one split; repeats inside one are none."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def require_disjoint(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    found = conflicts(rows, key, split).limit(5).collect()
    if found:
        raise ValueError(f"in several splits: {[r[0] for r in found]}")
    return rows


def complete_scenes(files: DataFrame, tiles: int = 100, images: DataFrame | None = None, incomplete: str = "error") -> DataFrame:
    """(region, scene, scene_id, lat, lon, labels) of scenes (region, scene, tile) that have all their tiles and a name that parses.

    images (region, scene) lists scenes that have to have tiles. A scene that isn't whole, or has another name, is an error; with incomplete="drop" it is left out.
    """
    if incomplete not in ("error", "drop"):
        raise ValueError(f"incomplete is error or drop, not {incomplete}")
    rows = files.select("region", "scene", F.when(F.col("tile").between(0, tiles - 1), F.col("tile")).alias("tile"))
    if images is not None:
        rows = rows.unionByName(images.select("region", "scene", F.lit(None).cast(dict(rows.dtypes)["tile"]).alias("tile")))
    seen = rows.groupBy("region", "scene").agg(F.count_distinct("tile").alias("n")).withColumn("p", codec.parse_scene_name(F.col("scene")))
    if incomplete == "error":
        bad = seen.where((F.col("n") < tiles) | F.col("p").isNull()).select("region", "scene", "n").limit(5).collect()
        if bad:
            raise ValueError(f"scenes without all tiles, or with a name that isn't one: {[tuple(r) for r in bad]}")
    return seen.where((F.col("n") == tiles) & F.col("p").isNotNull()).select("region", "scene", "p.*")


def check_labels(rows: DataFrame, classes: int, most: int, labels: str = "labels") -> DataFrame:
    """rows; more labels than `most`, or one outside the vocabulary, is an error."""
    c = F.col(labels)
    bad = (F.size(c) > most) | F.exists(c, lambda x: (x < 0) | (x >= classes))
    return rows.withColumn(labels, F.when(bad, F.raise_error(F.lit("invalid labels"))).otherwise(c))


def label_histogram(rows: DataFrame, classes: int, labels: str = "labels") -> DataFrame:
    """(label_id, count, ratio) of all classes: occurrences, and by the number of rows; 0.0 without rows."""
    n = rows.agg(F.count("*").alias("rows"))
    seen = rows.select(F.explode(labels).alias("label_id")).groupBy("label_id").agg(F.count("*").alias("c"))
    every = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("label_id"))
    joined = every.join(seen, "label_id", "left").join(F.broadcast(n))
    return joined.select("label_id", F.coalesce("c", F.lit(0)).cast("long").alias("count"), F.when(F.col("rows") > 0, F.coalesce("c", F.lit(0)) / F.col("rows")).otherwise(F.lit(0.0)).alias("ratio"))


def split_counts(rows: DataFrame, split: str = "split") -> DataFrame:
    return rows.groupBy(split).agg(F.count("*").alias("rows"))


def split_manifest(rows: DataFrame, width: int) -> DataFrame:
    """id, lat, lon, label_0.., filepath: the wide form of a split."""
    return rows.select("id", "lat", "lon", *codec.padded(F.col("labels"), width), "filepath")


def grouped_manifest(rows: DataFrame, tiles: int = 100, width: int = 30) -> DataFrame:
    """id, lat, lon, lr_path, hr_0.., label_0..: one row per scene with the paths of all its tiles."""
    return rows.select("id", "lat", "lon", F.col("filepath").alias("lr_path"), *(codec.tile_path(F.col("filepath"), F.lit(i)).alias(f"hr_{i}") for i in range(tiles)), *codec.padded(F.col("labels"), width))


def map_label_groups(rows: DataFrame, mapping: DataFrame, key: str, labels: str = "labels") -> DataFrame:
    """(key, groups): distinct group ids of source labels, ascending; labels without a group are ignored; a source label with two groups is an error."""
    twice = mapping.groupBy("source_label").agg(F.count("*").alias("c")).where("c > 1").limit(5).collect()
    if twice:
        raise ValueError(f"mapped twice: {[r[0] for r in twice]}")
    each = rows.select(key, F.explode_outer(labels).alias("source_label")).join(mapping, "source_label", "left")
    return each.groupBy(key).agg(F.array_sort(F.collect_set("group_id")).alias("groups"))
