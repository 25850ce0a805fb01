"""Session, storage and table helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bound_batches, forget, shared_dir, ship, staged

#: Largest side that an operator broadcasts, in rows of a few longs each; larger sides are shuffled.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't use, whatever its case."""
    used, name = {c.lower() for c in df.columns}, base
    while name.lower() in used:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def large(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has too many rows to be broadcast."""
    return df.limit(rows + 1).count() > rows


def _trimmed(f):
    """f, after which a worker gives its free memory back: workers are kept for later tasks, several for each core."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        yield from f(batches)
        # Only glibc has it; elsewhere memory is kept.
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow(f, schema), with this package on the executors and batches bounded by bytes: rows may hold whole books."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(_trimmed(f), schema)


__all__ = ["BROADCAST_ROWS", "distinct_name", "forget", "large", "map_arrow", "partitions", "shared_dir", "staged", "table"]
