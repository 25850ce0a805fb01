"""Writers. Spark's commit protocol publishes a folder as a whole; an existing one is an error unless it may be overwritten."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import codec


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def scene_index_rows(patches: DataFrame) -> DataFrame:
    """The text form of the scene index, whose column names are fixed: classes joined by |, fractions with 4 (relative) and 8 (absolute) decimals."""
    return patches.select("patch_id", "center_lat", "center_lon", "sent_min_lat", "sent_min_lon", "sent_max_lat", "sent_max_lon", codec.encode_classes(F.col("classes")).alias("classes"), codec.encode_fractions(F.col("class_fracs"), 4).alias("class_fracs"), codec.encode_fractions(F.col("class_fracs_abs"), 8).alias("class_fracs_abs"))


def tile_index_rows(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("tile_class_fracs", codec.encode_fractions(F.col("tile_class_fracs"), 4))


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode(_mode(overwrite)).option("header", True).csv(path)


def write_counted(rows: DataFrame, path: str, overwrite: bool = False) -> int:
    """Writes CSV and returns the number of rows, counted as they are written."""
    seen = Observation()
    write_csv(rows.observe(seen, F.count(F.lit(1)).alias("rows")), path, overwrite)
    return int(seen.get["rows"])


def publish_pair(rows: dict[str, DataFrame], root: str, name: str, overwrite: bool = False) -> str:
    """Writes several tables that belong together and publishes them at once: a version's folder is filled first, then a new file of a log, numbered and never replaced, names it.

    Readers (read_pair) follow the highest file that is whole, so they see all tables of one version or all of another, at any time and after a failure at any step. A file is
    created only if it isn't there, so of two writers that began with the same version one fails. Older versions are left to whoever cleans up. Where overwrite isn't set, an
    earlier version is an error.
    """
    spark = next(iter(rows.values())).sparkSession
    held = published(spark, root, name)
    if held and not overwrite:
        raise ValueError(f"{root}/{name} exists")
    base = max(_log(spark, root, name), default=-1)
    version = uuid.uuid4().hex
    for table, df in rows.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/{version}/{table}")
    path = f"{root}/{name}/log/{base + 1:012d}.json"
    if not _create(spark, path, json.dumps({"version": version, "tables": sorted(rows)})):
        raise ValueError(f"another writer has published {root}/{name}")
    return version


def read_pair(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """The tables that were last published under that name."""
    head = published(spark, root, name)
    if head is None:
        raise ValueError(f"nothing is published as {root}/{name}")
    return {t: spark.read.parquet(f"{root}/{name}/{head['version']}/{t}") for t in head["tables"]}


def published(spark: SparkSession, root: str, name: str) -> dict[str, Any] | None:
    """What the highest whole file of the log says; none if there is none."""
    for path in (p for _, p in sorted(_log(spark, root, name).items(), reverse=True)):
        text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        try:
            return json.loads(text)
        except ValueError:  # a writer has just made it, or never came to its end
            continue
    return None


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _log(spark: SparkSession, root: str, name: str) -> dict[int, str]:
    """Number and path of each file of a log."""
    files, at = _files(spark, f"{root}/{name}/log")
    listed = [s.getPath() for s in files.listStatus(at)] if files.exists(at) else []
    return {int(p.getName()[:12]): p.toString() for p in listed if re.fullmatch(r"\d{12}\.json", p.getName())}


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file if there is none; whether it did."""
    files, at = _files(spark, path)
    try:
        out = files.create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def write_index(patches: DataFrame, tiles: DataFrame, scene_path: str, tile_path: str, overwrite: bool = False) -> None:
    """Both tables of a spatial index."""
    write_csv(scene_index_rows(patches), scene_path, overwrite)
    write_csv(tile_index_rows(tiles), tile_path, overwrite)


def write_shard(rows: DataFrame, root: str, task: str, split: str, index: int, shards: int, overwrite: bool = False) -> str:
    """Writes one shard of scores; its name holds its place (the form part-NNNNN-of-NNNNN is fixed)."""
    if not 0 <= index < shards:
        raise ValueError("shard index out of range")
    path = f"{root}/task={task}/split={split}/part-{index:05d}-of-{shards:05d}"
    rows.write.mode(_mode(overwrite)).parquet(path)
    return path


def report_row(report: DataFrame) -> DataFrame:
    """A report as one column of JSON."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


def write_json(report: dict[str, Any], path: str | Path) -> None:
    """A report for people: indented, with a final line end; written beside and then renamed."""
    target = Path(path)
    beside = target.with_name(f"{target.name}.part")
    beside.write_text(json.dumps(report, indent=2) + "\n", encoding="utf-8")
    beside.replace(target)
