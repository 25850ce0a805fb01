"""Intermediate tables in the folder that driver and executors share, and this package on the executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of a batch that goes to a Python worker, unless the session names its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset the context's checkpoint folder. With neither, a temporary folder in local mode and an error on a cluster, whose executors couldn't read it."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
    if not held.isDefined():
        context.setCheckpointDir(path)
    return path


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # A task holds a group of rows in memory until it is written.
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._staged_path = path
    return held


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: all that was made of them has been written."""
    for df in tables:
        if path := getattr(df, "_staged_path", None):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to Python workers are bounded by bytes: rows may hold whole books, or long arrays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application; the driver serves the archive to them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessella-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(str(archive))
