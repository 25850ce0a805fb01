"""Incremental work: what is done stays done, and shards are merged as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of work whose keys aren't done. Running it again after a failure takes up only what is left."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def merge_arriving_shards(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, index: str = "sample_idx", files: int = 1000) -> StreamingQuery:
    """Appends each new shard file's rows to target, once: an index that comes twice, in one batch or in two, is an error for the query, not silently dropped.

    A state of the indices that have come, without Python, says which of a batch are new, so a batch costs as much as its own rows, whatever target holds by then. The rows pass beside it, and a batch
    that has more rows than new indices is refused. The state of a batch that fails isn't kept, and batches have a folder of their own and at most that many files each, so a batch that is tried
    again meets the state it met before and overwrites itself. Rows with a null index count as one index.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    new = stream.select(index).dropDuplicates([index]).select(F.lit(None).cast(stream.schema).alias("row"))
    marked = stream.select(F.struct(*stream.columns).alias("row")).unionByName(new)

    def append(batch: DataFrame, number: int) -> None:
        # The state is made once: what is checked is what has been written.
        batch.write.mode("overwrite").parquet(f"{target}/_arriving/{number}")
        held = batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/_arriving/{number}")
        rows = held.where("row IS NOT NULL").select("row.*")
        n = held.agg(F.count("row").alias("rows"), F.count_if(F.col("row").isNull()).alias("new")).first()
        if n["rows"] != n["new"]:
            raise ValueError(f"repeated {index} in batch {number}")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        at = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{target}/_arriving/{number}")
        at.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(at, True)

    return marked.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
