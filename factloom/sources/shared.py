"""Folders of our own in the storage that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a new one only in local mode where none is set, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="factloom-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new(spark: SparkSession, name: str) -> str:
    """A path that nobody else uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(spark: SparkSession) -> None:
    """Let go of the shuffle files of what is done, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


_KEPT: dict[tuple, object] = {}


def once(spark: SparkSession, name: str, source: str, write: Callable[[str], None], read: Callable[[str], object]):
    """What read gives of a path that write has filled, made at the first call for a source in this application."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _KEPT:
        path = new(spark, name)
        write(path)
        _KEPT[key] = read(path)
    return _KEPT[key]
