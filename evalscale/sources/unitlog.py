"""A log of units that is kept while a job runs, as a data source of Spark.

A task writes what it has finished, or makes of its rows on the way, in segments, files of whole units that are put in
place by a rename, so they stay if the task or the job is lost; only units that were
open then are made again.  A task that runs twice may log a unit twice: of its
segments the newest counts.  Units end when the key changes, so rows of a unit must
follow each other in a task.

Segments are Parquet: who asks which units are there reads the column of keys only.
"""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# a data source also starts in processes of Spark's driver that have only the environment's path, so it takes its code along
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = "log_key"


@dataclass
class Written(WriterCommitMessage):
    units: int
    segments: int


class Segments(DataSourceArrowWriter):
    def __init__(self, path: str, units: int, seconds: float, through: bytes | None):
        self.path, self.units, self.seconds, self.through = path, units, seconds, through

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        if self.through is not None:
            iterator = cloudpickle.loads(self.through)(iterator)
        held: list[pa.RecordBatch] = []
        done, waiting, segments, since, last = 0, 0, 0, time.monotonic(), None

        def put(batches: list[pa.RecordBatch]) -> None:
            nonlocal segments, since
            name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
            files.create_dir(base, recursive=True)
            pq.write_table(pa.Table.from_batches(batches), f"{base}/_{name}.open", filesystem=files)
            files.move(f"{base}/_{name}.open", f"{base}/{name}.parquet")
            segments, since = segments + 1, time.monotonic()

        try:
            for batch in iterator:
                keys = batch.column(batch.schema.get_field_index(KEY))
                n = len(keys)
                if not n:
                    continue
                changes = (pc.sum(pc.not_equal(keys.slice(1), keys.slice(0, n - 1))).as_py() if n > 1 else 0) + (last is not None and keys[0].as_py() != last)
                last, waiting = keys[n - 1].as_py(), waiting + changes
                held.append(batch)
                if waiting and (waiting >= self.units or time.monotonic() - since >= self.seconds):
                    tail, whole = _open_unit(held, last)
                    put(whole)
                    done, waiting, held = done + waiting, 0, tail
        except Exception:
            # the last unit may be open; those before it are whole
            whole = _open_unit(held, last)[1] if self.through is None else held
            if whole:
                put(whole)
            raise
        if held:
            put(held)
            done += waiting + 1
        return Written(done, segments)


def _open_unit(batches: list[pa.RecordBatch], last: str) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    """Cuts the rows of the last key off the end."""
    tail: list[pa.RecordBatch] = []
    whole = list(batches)
    while whole:
        batch = whole.pop()
        keys = batch.column(batch.schema.get_field_index(KEY)).to_pylist()
        at = len(keys)
        while at and keys[at - 1] == last:
            at -= 1
        tail.insert(0, batch.slice(at))
        if at:
            whole.append(batch.slice(0, at))
            break
    return [t for t in tail if t.num_rows], whole


class UnitLog(DataSource):
    """Options: path, `units` (those of a segment) and `seconds` (after which finished ones are written anyway)."""

    through: bytes | None = None

    @classmethod
    def name(cls) -> str:
        return "unit_log"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Segments(self.options["path"], int(self.options.get("units", 100)), float(self.options.get("seconds", 5)), self.through)


def append(rows: DataFrame, path: str, units: int = 100, seconds: float = 5.0, through: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> None:
    """Logs rows with a column `log_key`, of which those of a unit follow each other in their task.

    With `through` a task logs what that makes of its batches: a batch for each unit, in
    any order.  It runs beside the file, so no buffer stands between a unit and its segment.
    """
    spark = rows.sparkSession
    spark.dataSource.register(UnitLog if through is None else type("UnitLogThrough", (UnitLog,), {"through": cloudpickle.dumps(through)}))
    rows.write.format("unit_log").option("path", path).option("units", units).option("seconds", seconds).mode("append").save()


def logged_keys(spark: SparkSession, path: str) -> DataFrame:
    """The distinct keys of a log that has segments."""
    return spark.read.parquet(path).select(KEY).distinct()


def logged_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each unit, from the newest segment that has it."""
    rows = spark.read.parquet(path).withColumn("__segment", F.col("_metadata.file_name"))
    newest = F.max("__segment").over(Window.partitionBy(KEY))
    return rows.withColumn("__newest", newest).where("__segment = __newest").drop("__segment", "__newest")
