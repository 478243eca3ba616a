"""Incremental append with a checkpoint, and running accuracy, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evalscale.operators.dedupe import keep_last


def stream_rows(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files of a log folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_units(rows: DataFrame, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's newest row per key.  A batch that runs again replaces its own folder, so none is lost or doubled."""

    def write(batch: DataFrame, number: int) -> None:
        keep_last(batch, keys).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """T5: the newest row of each key over all batches; a later batch wins."""
    return keep_last(spark.read.parquet(target), keys, ("batch", "ord")).drop("batch")


def running_accuracy(selections: DataFrame) -> DataFrame:
    """Correct and scored so far per condition, as a streaming aggregate (complete or update mode)."""
    return selections.groupBy("dataset", "model", "method").agg(F.count(F.lit(1)).alias("scored"), F.count_if("is_correct").alias("correct"))


def windowed_accuracy(selections: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: accuracy in time windows, with a watermark for late rows."""
    return selections.withWatermark("ts", late).groupBy(F.window("ts", width), "model").agg(F.count(F.lit(1)).alias("scored"), F.count_if("is_correct").alias("correct"))
