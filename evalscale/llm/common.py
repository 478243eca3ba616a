"""What the corpus operators share: written tables that cut lineage, size-checked joins, batches to Arrow."""

from __future__ import annotations

import atexit
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was measured to take no more than this.
BROADCAST_BYTES = 32 << 20
#: The same for sides that grow with the data and whose rows take many times their bytes in memory.
FEW_BYTES = 4 << 20
#: Where tables go in tests, when all of Spark runs in one process and no folder is set.
LOCAL_SHARED = "/tmp/evalscale-checkpoints"
#: Bytes of an Arrow batch, about: documents are long, and batches count twice, in the JVM and in the worker.
BATCH_BYTES = 4 << 20
#: Columns that know a row by its id and text, 128 bits in all.
ROW_KEY = ["key", "key2"]


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to `BATCH_BYTES`, if they are larger.  Plans read this when they run, so it stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where none is set and no cluster is (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them and the driver share")
    return (found or f"file://{LOCAL_SHARED}").rstrip("/")


#: Folders made and not yet removed, oldest first.
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver ends, or by `remove_since`."""
    path = f"{shared_dir(spark)}/evalscale/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    _made.append(path)
    return path


def made() -> int:
    """A mark for `remove_since`."""
    return len(_made)


def remove_since(spark: SparkSession, mark: int) -> None:
    """Removes the folders made since the mark but for the newest, which holds the result of those before."""
    for path in _made[mark:-1]:
        remove(spark, path)
    del _made[mark:-1]


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended: what is left is in the shared folder, under our name
        return


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    modest_batches(spark)
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fewer_parts(df: DataFrame, share: int = 8, least: int = 8) -> DataFrame:
    """A table that is small for its number of shuffle partitions, in an eighth as many: fewer files, and less work around each."""
    return df.coalesce(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // share))


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a (written) table is proven to fit a broadcast: counted, never guessed."""
    most = limit // row_bytes
    return df.select(F.lit(1)).limit(most + 1).count() <= most


def join_small(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Joins, with the right side broadcast if its measured size allows; else as a shuffled join that AQE may split."""
    return left.join(F.broadcast(right) if small(right, row_bytes, limit) else right, on, how)


def join_measured(left: DataFrame, right: DataFrame, on, how: str, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """As `join_small`, for a (written) right side whose rows differ in size: their bytes are summed."""
    fits = (right.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= limit
    return left.join(F.broadcast(right) if fits else right, on, how)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two hashes of a row's id and text, seeded differently."""
    return [F.xxhash64(doc_id, text).alias(ROW_KEY[0]), F.xxhash64(F.lit(1), text, doc_id).alias(ROW_KEY[1])]


def packed_longs(df: DataFrame, column: str) -> np.ndarray:
    """A column of whole numbers (not null) of a table whose size was checked before, as unsigned 64-bit values.

    Tasks pack their values, so the driver gets eight bytes a row, not an object.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], names=["data"])

    parts = [r.data for r in df.select(F.col(column).cast("long").alias("v")).mapInArrow(run, "data binary").collect()]
    return np.frombuffer(b"".join(parts), np.uint64)


def crc_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n
