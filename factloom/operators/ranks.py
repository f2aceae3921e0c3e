"""Ranks of rows, overall or within groups, without bringing a group together: a distributed sort and the offsets of its partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import cut

_PLACE = (1 << 33) - 1  # monotonically_increasing_id has the place in the partition in its lower 33 bits


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place, from 0, in an order. Rows that tie in all of it are in some order."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    before, offsets = 0, []
    for part, count in sorted(map(tuple, rows.groupBy(F.shiftright("__at", 33)).count().collect())):  # a row a partition
        offsets.append((part, before))
        before += count
    offset = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    joined = rows.withColumn("__part", F.shiftright("__at", 33)).join(offset, "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_PLACE))).drop("__at", "__part", "__before")


def ranked(df: DataFrame, per: list[str], order: list[Column], name: str) -> DataFrame:
    """df with each row's rank, from 1, among the rows with the same values of ``per``: its place in the order of all rows less that of its group's first."""
    rows = placed(df, [*[F.col(c).asc_nulls_first() for c in per], *order], "__place")
    if not per:
        return rows.withColumn(name, F.col("__place") + 1).drop("__place")
    first = cut(rows.groupBy(*per).agg(F.min("__place").alias("__first")))
    same = first.select(*[F.col(c).alias(f"__{c}") for c in per], "__first")
    on = F.lit(True)
    for c in per:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(same, on).withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__place", "__first", *[f"__{c}" for c in per])
