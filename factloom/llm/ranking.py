"""Global running sums without a global window, shared by sharding and mixing.

Rows are ordered by an MD5 key, so a key's first hex digits split any table evenly. One small aggregate gives each prefix its
total, a cumulative sum over at most 16**MAX_DIGITS prefixes gives offsets, and a window inside each prefix does the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DIGITS = 5


def key_of(*parts: Column, seed: int = 0) -> Column:
    """MD5 in hex of the parts, null written as a word."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def digits(rows: int, per_prefix: int = 50_000) -> int:
    """Hex digits so that a prefix holds about per_prefix rows."""
    return min(MAX_DIGITS, max(2, math.ceil(math.log(max(1, rows / per_prefix), 16))))


def running_sum(df: DataFrame, value: str, key: str, order: list[str], n_digits: int, name: str, within: list[str] = ()) -> DataFrame:
    """df with the sum of value over all earlier rows of the same ``within`` columns, in order of key and then order.

    The table of offsets has a row for each prefix and value of ``within``; it is broadcast only if Spark finds it small.
    """
    df = df.withColumn("__prefix", F.substring(key, 1, n_digits))
    sums = df.groupBy(*within, "__prefix").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*within).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("__prefix").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    same = F.col("__prefix") == F.col("__p")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    if not within:
        offsets = F.broadcast(offsets)  # 16**MAX_DIGITS rows at most
    inside = Window.partitionBy(*within, "__prefix").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(offsets, same).withColumn(name, F.col("__offset") + F.col("__own")).drop("__prefix", "__p", "__offset", "__own", *[f"__{c}" for c in within])
