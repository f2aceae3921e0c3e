"""Bloom filters as Spark tables: built in tasks, merged by segment, broadcast within a fixed bound, tested with SQL functions.

A row sets two bits of a bitmap kept in 64 Kibit segments. Every task folds its rows into sorted positions seen once and seen
again, and segments are merged. ``max_bits`` bounds the broadcast (at most ``max_bits / 8`` bytes, 256 MB by default) whatever
the input; a filter too small for its input only lets more rows pass as possible members.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEGMENT = 16  # bits of a position inside its segment
MAX_BITS = 1 << 31


def bits_for(rows: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, max(1 << SEGMENT, 1 << math.ceil(math.log2(16 * rows + 1))))


def positions(key: Column, bits: int, is_hash: bool = False) -> list[Column]:
    """Two bit positions from independent parts of a digest in hex, or of a 63-bit hash."""
    if is_hash:
        return [F.pmod(key, F.lit(bits)), F.pmod(F.shiftright(key, 31) + F.shiftleft(key.bitwiseAND(0x7FFFFFFF), 31), F.lit(bits))]
    hexed = key
    return [F.conv(F.substring(hexed, at, 12), 16, 10).cast("long") % bits for at in (1, 17)]


def _fold(batches):
    """Positions of this task as, for each segment, those seen once at least and those seen again."""
    import pyarrow as pa

    def flush(parts):
        pos, n = np.unique(np.concatenate(parts), return_counts=True)
        seg = pos >> SEGMENT
        heads = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(pos) else np.zeros(0, int)
        low, ends = (pos & 0xFFFF).astype("<u2"), np.r_[heads[1:], len(pos)] if len(pos) else []
        return pa.RecordBatch.from_pydict({
            "seg": pa.array(seg[heads], pa.int64()),
            "once": pa.array([low[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary()),
            "again": pa.array([low[a:b][n[a:b] > 1].tobytes() for a, b in zip(heads, ends)], pa.binary()),
        })

    parts, held = [], 0
    for b in batches:
        for c in b.columns:
            parts.append(c.to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(c)
        if held > 1_000_000:
            yield flush(parts)
            parts, held = [], 0
    if held:
        yield flush(parts)


def _merge(least: int):
    def merge(key, parts):
        """One segment's bitmap of positions hit ``least`` times at least; parts has a row for each task."""
        import pyarrow as pa

        seen, twice = np.zeros(1 << SEGMENT, bool), np.zeros(1 << SEGMENT, bool)
        for once, again in zip(parts["once"], parts["again"]):
            at = np.frombuffer(once.as_py(), "<u2")
            twice[at[seen[at]]] = True
            seen[at] = True
            twice[np.frombuffer(again.as_py(), "<u2")] = True
        return pa.table({"seg": pa.array([key[0].as_py()], pa.int64()), "bitmap": pa.array([np.packbits(twice if least > 1 else seen, bitorder="little").tobytes()], pa.binary())})

    return merge


def build(df: DataFrame, hexed: Column, bits: int, least: int = 1, is_hash: bool = False) -> DataFrame:
    """(seg, bitmap) of the positions that rows of df hit ``least`` times (1 or 2): at most bits / 2**16 rows of 8 KiB."""
    pos = df.select(*[c.alias(f"p{i}") for i, c in enumerate(positions(hexed, bits, is_hash))])
    parts = pos.mapInArrow(_fold, "seg long, once binary, again binary")
    return common.cut(parts.groupBy("seg").applyInArrow(_merge(least), "seg long, bitmap binary"))


def _test(df: DataFrame, segments: DataFrame, position: Column, name: str) -> DataFrame:
    at = position % (1 << SEGMENT)
    byte = F.conv(F.hex(F.substring("__bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    side = F.broadcast(segments.select(F.col("seg").alias("__seg"), F.col("bitmap").alias("__bitmap")))
    hit = F.coalesce(F.expr("shiftright(__byte, __bit) & 1") == 1, F.lit(False))
    df = df.withColumn("__at", F.floor(position / (1 << SEGMENT))).join(side, F.col("__at") == F.col("__seg"), "left")
    return df.withColumn("__byte", byte).withColumn("__bit", (at % 8).cast("int")).withColumn(name, hit).drop("__at", "__seg", "__bitmap", "__byte", "__bit")


def test(df: DataFrame, hexed: Column, segments: DataFrame, bits: int, name: str, is_hash: bool = False) -> DataFrame:
    """df with a boolean column: whether both positions are set. Never false for a member."""
    for i, p in enumerate(positions(hexed, bits, is_hash)):
        df = _test(df, segments, p, f"__hit{i}")
    return df.withColumn(name, F.col("__hit0") & F.col("__hit1")).drop("__hit0", "__hit1")


def split(df: DataFrame, ids: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose id may be among ids (which is kept in shared storage), and those whose id is surely not."""
    bits = bits_for(ids.count())
    key = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("null")))
    tested = test(df, key, build(ids, key, bits), bits, "__maybe")
    return tested.where("__maybe").drop("__maybe"), tested.where("NOT __maybe").drop("__maybe")


def pick(df: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """df inner-joined with ids on id; only rows that may match are shuffled."""
    return split(df, ids, id)[0].join(ids.hint("shuffle_hash"), id)


def without(df: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """df without the rows whose id is among ids; only rows that may match are shuffled."""
    maybe, no = split(df, ids, id)
    return no.unionByName(maybe.join(ids.select(id).hint("shuffle_hash"), id, "left_anti"))
