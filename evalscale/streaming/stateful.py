"""Streams with state: the newest row of each key, and running accuracy in event order.

State is kept in RocksDB, by Spark's own aggregates, and a batch's work follows the
batch: no earlier batch is read again.  What is kept can be read from the checkpoint at any time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evalscale.operators import numbering
from evalscale.sources import folders

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def keep_newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """T5: the newest row of each key by `order`, without an end; in update mode the keys that a batch changed.

    One value per key, merged within the JVM and before the shuffle too.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("newest")).select(*keys, "newest.*")


def keep_newest_for(rows: DataFrame, keys: Sequence[str], order: str, ttl_ms: int, late: str) -> DataFrame:
    """T5 with a time to live: the newest row of each key by event time `ts`, then `order`; in update mode.

    State is a value per key and slot of expiry, an eighth of the time to live wide; Spark
    drops a slot once the watermark, `late` behind the newest time, is the time to live beyond
    its last row.  The slots of keys that a batch changed come out, each with its newest row:
    a key's newest one is the newest over its slots by `at`, the event time in microseconds,
    and `order`; `kept_values` reads it from the state.
    """
    rest = [c for c in rows.columns if c not in (*keys, "ts", order)]
    expiry = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + ttl_ms * 1000)
    timed = rows.withColumns({"at": F.unix_micros(F.col("ts").cast("timestamp")), "__expiry": expiry})
    timed = timed.withWatermark("__expiry", f"{ttl_ms} milliseconds {late}")
    slot = F.window("__expiry", f"{max(1, ttl_ms // 8)} milliseconds")
    return timed.groupBy(*keys, slot.alias("slot")).agg(F.max(F.struct("at", order, *rest)).alias("newest")).select(*keys, "newest.*")


@dataclass(frozen=True)
class InOrder:
    """A stream of rows that come once their order is complete, and the keys by which `run_through` counts them on."""

    rows: DataFrame
    keys: tuple[str, ...]


def running_in_order(selections: DataFrame, keys: Sequence[str], late: str) -> InOrder:
    """Each selection (keys, `ts`, `ord`, `is_correct`) with those scored and correct in its group so far, itself included.

    The order is that of event time, then `ord`.  A row is emitted once the watermark,
    `late` behind the newest time, has passed it; what comes later than that is dropped.
    Rows wait in state by key, time and `ord`, so no task holds a group.
    """
    timed = selections.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.groupBy(*keys, "ts", F.col("ord").cast("long").alias("ord")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("good"))
    return InOrder(rows, tuple(keys))


def counted_on(batch: DataFrame, keys: Sequence[str], totals: str, number: int) -> DataFrame:
    """Running counts of a batch's rows, all of which follow those of earlier batches in their order.

    What each group has had by the end of the batch is written to a folder of the batch's number.
    """
    spark = batch.sparkSession
    fields = T.StructType([*[batch.schema[k] for k in keys], T.StructField("__scored", T.LongType()), T.StructField("__correct", T.LongType())])
    past = sorted(n for n in (int(e.name.split("=")[1]) for e in folders.listing(spark, totals)) if n < number)
    before = spark.read.schema(fields).parquet(f"{totals}/batch={past[-1]}") if past else spark.createDataFrame([], fields)
    came = batch.select(*keys, F.col("n").alias("__scored"), F.col("good").alias("__correct")).unionByName(before)
    summed = came.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("__scored", "__correct")])
    summed.coalesce(1).write.mode("overwrite").parquet(f"{totals}/batch={number}")  # a row per group
    for n in past[:-1]:
        folders.remove(spark, f"{totals}/batch={n}")
    copies = F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))
    rows = batch.withColumn("__copy", copies).withColumn("__good", (F.col("__copy") > F.col("n") - F.col("good")).cast("long"))
    totalled = {"scored": F.lit(1), "correct": F.col("__good")}
    done = numbering.running(rows.withColumn("__at", F.unix_micros("ts")), keys, "__at", totalled, within=("__at", "ord", "__copy"))
    same = F.lit(True)
    for k in keys:
        same &= done[k].eqNullSafe(before[k])
    plus = lambda name: (F.col(name) + F.coalesce(f"__{name}", F.lit(0))).alias(name)
    return done.join(before, same, "left").select(*[done[k] for k in keys], "ord", plus("correct"), plus("scored"))


def run_through(rows: DataFrame | InOrder, target: str | None, checkpoint: str, mode: str) -> StreamingQuery:
    """Runs a stream over all that is there; a batch's rows replace those of the same batch if it runs again."""
    stream = rows.rows if isinstance(rows, InOrder) else rows

    def write(batch: DataFrame, number: int) -> None:
        if isinstance(rows, InOrder):
            due = f"{checkpoint}/due"  # written, as it is read more than once
            batch.write.mode("overwrite").parquet(due)
            batch = counted_on(batch.sparkSession.read.schema(batch.schema).parquet(due), rows.keys, f"{checkpoint}/totals", number)
        if target is None:
            batch.write.format("noop").mode("overwrite").save()
        else:
            batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def kept_values(spark: SparkSession, checkpoint: str, name: str | None = None) -> DataFrame:
    """`key` and `value` of a stream's state, read from its checkpoint; if a column of the state is named, its newest value of each key over all slots."""
    kept = spark.read.format("statestore").load(checkpoint)
    if name is None:
        return kept
    keys = [k for k in kept.schema["key"].dataType.names if k != "slot"]
    return kept.groupBy(F.struct(*[F.col(f"key.{k}").alias(k) for k in keys]).alias("key")).agg(F.max("value.max").alias("value"))
