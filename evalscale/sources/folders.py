"""Folders and small files on any file system that Spark knows, by URI or path."""

from __future__ import annotations

import atexit
import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

#: Where scratch folders go in tests, when all of Spark runs in one process and no folder is set.
LOCAL_SHARED = "file:///tmp/evalscale-checkpoints"


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    is_dir: bool
    size: int


def _open(spark: SparkSession, path: str) -> tuple[Any, Any]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _entries(found) -> list[Entry]:
    return [Entry(f.getPath().toString(), f.getPath().getName(), f.isDirectory(), f.getLen()) for f in found or ()]


def listing(spark: SparkSession, path: str) -> list[Entry]:
    """What a folder holds, by name; nothing if it does not exist."""
    files, target = _open(spark, path)
    return sorted(_entries(files.listStatus(target)), key=lambda e: e.name) if files.exists(target) else []


def matching(spark: SparkSession, pattern: str) -> list[Entry]:
    """Files and folders that a glob matches, by path."""
    files, target = _open(spark, pattern)
    return sorted(_entries(files.globStatus(target)), key=lambda e: e.path)


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _open(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    files, target = _open(spark, path)
    files.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    files, target = _open(spark, path)
    source = files.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8")
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then put there."""
    files, target = _open(spark, path)
    fresh = target.suffix(f".{uuid.uuid4().hex}.new")
    out = files.create(fresh, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(fresh), files.makeQualified(target), overwrite)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all of the cluster sees, in the one that it names for checkpoints; removed when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them and the driver share")
    path = f"{(shared or LOCAL_SHARED).rstrip('/')}/evalscale/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended: what is left is in the shared folder, under our name
        return
