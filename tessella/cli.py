"""Commands: `python -m tessella STAGE ...` runs one stage from tables to tables and prints a report as JSON.

With --dry-run a stage only opens its inputs and says what it would write.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DataProfile
from .plans import pipelines
from .sources import readers, writers


@dataclass(frozen=True)
class Stage:
    """What a command needs, what it writes, and how. inputs and outputs are names of arguments; opened gives the input tables by what they are called, and fails where they aren't there."""

    run: Callable[[SparkSession, argparse.Namespace], dict[str, Any]]
    opened: Callable[[SparkSession, argparse.Namespace], dict[str, DataFrame]]
    outputs: tuple[str, ...] = ()
    options: tuple[tuple[str, dict[str, Any]], ...] = field(default=())


def _index(spark: SparkSession, a: argparse.Namespace) -> dict[str, Any]:
    shape = lambda path: readers.read_footprints(spark, path).select("parts") if path else None
    scenes, tiles = pipelines.build_index(readers.read_features(spark, a.features), a.region, shape(a.footprint), shape(a.tile_footprint), a.predicate, a.halfwidth, a.scale, least_classes=a.least_classes, coverage_min=a.coverage, spacing=a.spacing, limit=a.limit)
    version = writers.publish_pair({"scenes": scenes, "tiles": tiles}, a.output, a.region, a.overwrite)
    found = writers.read_pair(spark, a.output, a.region)
    return {"region": a.region, "version": version, **{name: df.count() for name, df in found.items()}}


def _sample(spark: SparkSession, a: argparse.Namespace) -> dict[str, Any]:
    held = writers.read_pair(spark, a.index, a.region)
    most = a.most if a.most is not None else held["scenes"].count()
    scenes = held["scenes"].withColumn("region", F.lit(a.region)).withColumn("ord", F.col("patch_id"))
    kept, tiles = pipelines.sample_index(scenes, held["tiles"], most, a.seed, native=a.hashed)
    writers.publish_pair({"scenes": kept.drop("region", "ord"), "tiles": tiles}, a.output, a.region, a.overwrite)
    return {"region": a.region, "most": most, **{name: df.count() for name, df in writers.read_pair(spark, a.output, a.region).items()}}


def _split(spark: SparkSession, a: argparse.Namespace) -> dict[str, Any]:
    profile = DataProfile.load(a.profile)
    rows, histogram = pipelines.construct_splits(readers.scan_scene_files(spark, a.root), profile, a.tiles, readers.scan_scene_images(spark, a.root))
    rows.write.mode("overwrite" if a.overwrite else "errorifexists").partitionBy("split").parquet(f"{a.output}/scenes")
    histogram.write.mode("overwrite" if a.overwrite else "errorifexists").parquet(f"{a.output}/labels")
    return {"profile": profile.name, "rows": {r["split"]: r["rows"] for r in spark.read.parquet(f"{a.output}/scenes").groupBy("split").agg(F.count("*").alias("rows")).collect()}}


def _expand(spark: SparkSession, a: argparse.Namespace) -> dict[str, Any]:
    read = lambda path: readers.require_columns(spark.read.parquet(path), ["id", "lat", "lon", "filepath", "labels"])
    out = pipelines.expand_manifest({name: read(path) for name, path in (m.split("=", 1) for m in a.manifest)}, a.width, a.tiles)
    return {"rows": {name: writers.write_counted(df, f"{a.output}/{name}", a.overwrite) for name, df in out.items()}}


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> dict[str, Any]:
    parts = [readers.read_shards(spark, p, a.format) for p in a.shard]
    rows = pipelines.evaluate(parts, a.task, a.samples, tuple(int(k) for k in a.ks.split(",")), a.base, a.classes).collect()
    report = {"task": a.task, "samples": a.samples, "metrics": [r.asDict() for r in rows]}
    if a.output:
        writers.write_json(report, a.output)
    return report


def _tables(*names: str) -> Callable[[SparkSession, argparse.Namespace], dict[str, DataFrame]]:
    def opened(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
        given = [getattr(a, n) for n in names]
        return {p: spark.read.parquet(p) for v in given for p in (v if isinstance(v, list) else [v])}

    return opened


def _pair(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    return {f"{a.index}/{a.region}/{name}": df for name, df in writers.read_pair(spark, a.index, a.region).items()}


def _scenes(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    DataProfile.load(a.profile)
    return {a.root: readers.scan_scene_files(spark, a.root)}


def _manifests(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    return {path: spark.read.parquet(path) for path in (m.split("=", 1)[1] for m in a.manifest)}


_OUT = (("--output", {"required": True}), ("--overwrite", {"action": "store_true"}))
STAGES: dict[str, Stage] = {
    "index": Stage(_index, _tables("features"), ("output",), (
        ("--features", {"required": True}), ("--region", {"required": True}), ("--footprint", {}), ("--tile-footprint", {}), ("--predicate", {"default": "covers", "choices": ["covers", "contains"]}),
        ("--halfwidth", {"type": float, "default": 0.0012}), ("--scale", {"type": float, "default": 10.0}), ("--least-classes", {"type": int, "default": 2}), ("--coverage", {"type": float, "default": 0.0}),
        ("--spacing", {"type": float, "default": 0.01}), ("--limit", {"type": int}), *_OUT)),
    "sample": Stage(_sample, _pair, ("output",), (("--index", {"required": True}), ("--region", {"required": True}), ("--most", {"type": int}), ("--seed", {"type": int, "default": 42}), ("--hashed", {"action": "store_true"}), *_OUT)),
    "split": Stage(_split, _scenes, ("output",), (("--profile", {"required": True}), ("--root", {"required": True}), ("--tiles", {"type": int, "default": 100}), *_OUT)),
    "expand": Stage(_expand, _manifests, ("output",), (("--manifest", {"required": True, "action": "append", "help": "name=path, once for each split"}), ("--width", {"type": int, "default": 30}), ("--tiles", {"type": int, "default": 100}), *_OUT)),
    "evaluate": Stage(_evaluate, _tables("shard"), ("output",), (
        ("--shard", {"required": True, "action": "append"}), ("--task", {"required": True}), ("--samples", {"type": int, "required": True}), ("--ks", {"default": "20,100"}), ("--base", {"type": int}),
        ("--classes", {"type": int, "default": 0}), ("--format", {}), ("--output", {}))),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella", description=__doc__.splitlines()[0])
    stages = top.add_subparsers(dest="stage", required=True)
    for name, stage in STAGES.items():
        one = stages.add_parser(name)
        one.add_argument("--dry-run", action="store_true")
        for flag, settings in stage.options:
            one.add_argument(flag, **settings)
    return top


def planned(spark: SparkSession, name: str, a: argparse.Namespace) -> dict[str, Any]:
    """What a stage would do; its input tables are opened, which fails where they aren't there, and nothing is written."""
    stage = STAGES[name]
    opened = stage.opened(spark, a)
    arguments = {k: v for k, v in vars(a).items() if k not in ("stage", "dry_run") and v is not None}
    return {"status": "planned", "stage": name, "inputs": {p: df.columns for p, df in opened.items()}, "outputs": [v for o in stage.outputs if (v := getattr(a, o))], "arguments": arguments}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict[str, Any]:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    report = planned(spark, a.stage, a) if a.dry_run else STAGES[a.stage].run(spark, a)
    print(json.dumps(report, indent=2, default=str))
    return report
