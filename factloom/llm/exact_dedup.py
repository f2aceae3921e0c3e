"""Exact dedup: a two-pass Bloom filter finds hashes that may repeat; only their rows are shuffled.

Pass 1 sets two bits a row in a bitmap kept in 64 Kibit segments. Every task folds its rows into sorted positions
seen once and seen again, and segments are merged, so that what remains is the set of positions hit at least twice.
Pass 2 tests every row against that set: a row with a position hit once is unique and passes straight through;
the rest are grouped by digest. The filter has at most ``max_bits`` bits, so its broadcast is bounded by
``max_bits / 8`` bytes whatever the input; a filter too small for the input only lets more rows be shuffled.

Null and empty texts are equal to each other. Of rows that tie on the largest id, exactly one is kept.
An empty table gives an empty result. ``mark`` replaces columns of the input that have an added column's name, ``distinct`` keeps all;
names that begin with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, common

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def digest(text: Column) -> Column:
    """SHA-256 of the text, A-Z lower-cased."""
    return F.sha2(F.encode(common.lower_ascii(F.coalesce(text, F.lit(""))), "UTF-8"), 256)


def _marked(hashed: DataFrame, id: str, max_bits: int) -> DataFrame:
    """hashed, which has ``__sha``, with ``__keep_id``, ``__size`` and ``__kept``. Rows whose digest can't repeat are not shuffled."""
    columns = [f"`{c}`" for c in hashed.columns]
    bits = bloom.bits_for(hashed.count(), max_bits)
    sha, maybe = F.col("__sha"), F.col("__maybe")
    tested = bloom.test(hashed, sha, bloom.build(hashed, sha, bits, least=2), bits, "__maybe")
    alone = tested.where(~maybe).select(*columns, F.col(id).alias("__keep_id"), F.lit(1).cast("long").alias("__size"), F.lit(True).alias("__kept"))
    repeated = common.cut(tested.where(maybe).select(*columns, F.monotonically_increasing_id().alias("__row")))  # row numbers are fixed once
    groups = repeated.groupBy("__sha").agg(F.max(F.struct(F.col(id).alias("__keep_id"), F.col("__row").alias("__keep_row"))).alias("k"), F.count("*").alias("__size")).select("__sha", "k.*", "__size")
    groups = common.cut(groups)  # the join then has plain shuffles on both sides, so a hot digest's partition can be split
    again = repeated.join(groups, "__sha").select(*columns, "__keep_id", "__size", (F.col("__row") == F.col("__keep_row")).alias("__kept"))
    return alone.unionByName(again)


def mark(df: DataFrame, id: str = "doc_id", text: str = "text", hashed: DataFrame | None = None, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """Each row of df with keep_id, group_size, kept and text_sha256.

    hashed: df with ``text_sha256`` and only the columns wanted, if that is at hand.
    """
    if hashed is None:
        hashed = df.drop(*[c for c in df.columns if c in ADDED]).withColumn("text_sha256", digest(F.col(text)))
    marked = _marked(hashed.withColumnRenamed("text_sha256", "__sha"), id, max_bits)
    return marked.withColumnsRenamed({"__sha": "text_sha256", "__keep_id": "keep_id", "__size": "group_size", "__kept": "kept"})


def distinct(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without its copies, all columns as they were."""
    return _marked(df.withColumn("__sha", digest(F.col(text))), id, bloom.MAX_BITS).where("__kept").select(*[f"`{c}`" for c in df.columns])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    hashed = common.cut(docs.select("doc_id", digest(F.col("text")).alias("text_sha256")))
    return mark(docs, hashed=hashed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLE = {
    "op10_exact_dedup": """
WITH h AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM h"""
}
