"""Indexes kept up to date by streams, and counts of log events by day."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import indexing


def daily_counts(events: DataFrame, time: str = "ts", key: str = "event_type", late: str = "1 day") -> DataFrame:
    """Events of each day and key; on a stream, days older than the watermark are final."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), key, "n")


LAYERS = 16  # layers after which an index is written whole


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, folder: str) -> list[str]:
    """All complete layers in order of their batches. A layer counts once its writer has committed it (_SUCCESS)."""
    root, fs = _fs(spark, folder)
    if not fs.exists(root):
        return []
    return sorted(n for f in fs.listStatus(root) if re.fullmatch(r"v-\d{12}(-whole)?", n := f.getPath().getName()) and fs.exists(_fs(spark, f"{folder}/{n}/_SUCCESS")[0]))


def _layers(spark: SparkSession, folder: str, before: int | None = None) -> list[str]:
    """Layers that make up the index, from the last whole one on; of batches before a number if that is given."""
    names = [n for n in _complete(spark, folder) if before is None or int(n[2:14]) < before]
    whole = [i for i, n in enumerate(names) if n.endswith("-whole")]
    return names[whole[-1] :] if whole else names


def _belongs(spark: SparkSession, folder: str, checkpoint: str) -> None:
    """The index is kept by one stream: its checkpoint's id is written beside the layers, another's is refused."""
    own = spark.read.text(f"{checkpoint}/metadata").first()[0]
    path, fs = _fs(spark, f"{folder}/stream")
    if fs.exists(path):
        stored = spark.read.text(f"{folder}/stream").first()[0]
        if stored != own:
            raise ValueError(f"the index in {folder} is kept by another stream; start it from that stream's checkpoint or in a new folder")
        return
    if _complete(spark, folder):
        raise ValueError(f"the index in {folder} has no stream that it belongs to")
    out = fs.create(path)
    try:
        out.write(bytearray(own.encode()))
    finally:
        out.close()


def _read(spark: SparkSession, folder: str, names: list[str], key: list[str], only: DataFrame | None = None) -> DataFrame:
    """Blocks of postings, of each its row in the latest layer; only those with the given places, looked up in each layer before layers are compared."""
    rows = [spark.read.parquet(f"{folder}/{n}").withColumn("__layer", F.lit(i)) for i, n in enumerate(names)]
    if only is not None:
        rows = [r.join(only, ["document_collection", *key, "block"], "left_semi") for r in rows]
    if len(rows) == 1:
        return rows[0].drop("__layer")
    at = ["document_collection", *key, "block"]
    latest = reduce(DataFrame.unionByName, rows).groupBy(*at).agg(F.max_by(F.struct("document_ids", "n"), "__layer").alias("x"))
    return latest.select(*at, "x.*")


def keep_index(new_rows: DataFrame, folder: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Merge a stream of (document_collection, key, document_id) into a stored index of postings.

    Each micro-batch writes a layer with only the blocks that its rows touch, named by the batch; a layer that a crash left incomplete is not read and is overwritten. Every LAYERS
    batches the index is written whole. Running a batch again starts from the layers before it and writes the same layer again: layers older than a whole one
    go no sooner than in a later batch, when the one that wrote it is committed. A batch that finds nothing before it, but is not the first, fails.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _belongs(spark, folder, checkpoint)
        before = _layers(spark, folder, number)
        if number and not before:
            raise ValueError(f"batch {number} finds no index in {folder}")
        for n in _complete(spark, folder):
            if before and n < before[0]:
                path, fs = _fs(spark, f"{folder}/{n}")
                fs.delete(path, True)
        rows = batch.select("document_collection", *key, "document_id")
        name = f"v-{number:012d}"
        if not before:
            indexing.postings(rows, key).write.mode("overwrite").parquet(f"{folder}/{name}-whole")
            return
        if len(before) < LAYERS:
            touched = rows.select("document_collection", *key, F.floor(F.col("document_id") / indexing.BLOCK).alias("block")).distinct()
            old = _read(spark, folder, before, key, touched)
            indexing.changed_postings(old, rows, key).write.mode("overwrite").parquet(f"{folder}/{name}")
        else:
            indexing.merge_postings(_read(spark, folder, before, key), rows, key).write.mode("overwrite").parquet(f"{folder}/{name}-whole")

    return new_rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, key: list[str]) -> DataFrame | None:
    """The stored index, if there is one."""
    names = _layers(spark, folder)
    return _read(spark, folder, names, key) if names else None
