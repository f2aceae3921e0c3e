"""Running statistics of a usage log by period, as a stream with state of its own and timers.

An event counts for its day, ISO week, month and year, and for all time. The state of a (period, value) is its count; a timer ends it when the watermark has passed the
period by its delay, after which late events of it are dropped and the count is final. Frequent values are salted: a value's events of a period are
counted in ``SALTS`` parts by user, which are summed where the counts are read. Every micro-batch appends the counts that it changed; since counts only grow,
the largest one of each key is the current one, whatever batches ran again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SALTS = 16
PERIODS = ("day", "week", "month", "year")
EVER = "ever"
KEY = ["period", "start", "value", "salt"]
COUNT = "period string, start date, value string, salt int, n long, final boolean"


def _in_periods(events: DataFrame, time: str, value: str, user: str) -> DataFrame:
    """A row for each period of an event, with the period's end in milliseconds (null for all time)."""
    starts = [_period(p, F.date_trunc(p, F.col(time))) for p in PERIODS]
    starts.append(F.struct(F.lit(EVER).alias("period"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("long").alias("until")))
    salt = F.pmod(F.xxhash64(F.col(user)), F.lit(SALTS)).cast("int")
    return events.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(F.col(time).alias("time"), F.col(value).alias("value"), salt.alias("salt"), F.explode(F.array(*starts)).alias("p")).select("time", "value", "salt", "p.*")


def _period(name: str, start: Column) -> Column:
    length = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[name]
    return F.struct(F.lit(name).alias("period"), start.cast("date").alias("start"), F.unix_millis(start.cast("timestamp") + F.expr(length)).alias("until"))


def period_counts(events: DataFrame, time: str = "ts", value: str = "event_type", user: str = "user_id") -> DataFrame:
    """(period, start, value, n) of a table."""
    return _in_periods(events, time, value, user).groupBy("period", "start", "value").agg(F.count("*").alias("n"))


def _count(key, rows, state: GroupState):
    import pandas as pd

    def row(n: int, final: bool):
        return pd.DataFrame([(*key, n, final)], columns=["period", "start", "value", "salt", "n", "final"])

    if state.hasTimedOut:
        (n,) = state.get
        state.remove()
        yield row(n, True)
        return
    n, until = state.get[0] if state.exists else 0, None
    for frame in rows:
        n += len(frame)
        until = frame["until"].iloc[0]
    state.update((n,))
    if not pd.isna(until):
        # a period that the watermark has passed already ends at once
        state.setTimeoutTimestamp(max(int(until), state.getCurrentWatermarkMs() + 1))
    yield row(n, False)


def keep_counts(events: DataFrame, folder: str, checkpoint: str, time: str = "ts", value: str = "event_type", user: str = "user_id", late: str = "7 days") -> StreamingQuery:
    """Follow a stream of events; events that are late by more than ``late`` may be dropped."""
    rows = _in_periods(events.withWatermark(time, late), time, value, user)
    counts = rows.groupBy(*KEY).applyInPandasWithState(_count, COUNT, "n long", "update", GroupStateTimeout.EventTimeTimeout)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:012d}")

    return counts.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(period, start, value, n, final) as the stream has them."""
    parts = spark.read.schema(COUNT).parquet(folder).groupBy(*KEY).agg(F.max("n").alias("n"), F.max("final").alias("final"))
    return parts.groupBy("period", "start", "value").agg(F.sum("n").alias("n"), F.min("final").alias("final"))


def top_of_periods(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of each period, of equal ones the first by name."""
    best = Window.partitionBy("period", "start").orderBy(F.desc("n"), "value")  # one row a value
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
