"""The running statistics: a stream over shuffled events equals the batch, also after restarts and batches that run again."""

import random

from pyspark.sql import functions as F

from factloom.sources import star
from factloom.streaming import usage

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select("period", "start", "value", "n").collect()), key=repr)


def test_stream_equals_batch(spark, tmp_path):
    events = star.table(spark, SF, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    all_ = events.collect()
    random.Random(4).shuffle(all_)
    source, folder, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for i in range(3):
        spark.createDataFrame(all_[i::3], events.schema).write.mode("append").parquet(source)
        for again in range(2 if i == 1 else 1):
            if again:  # the commit of the last batch is lost: it runs again
                last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
                last.unlink()
                (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
            usage.keep_counts(spark.readStream.schema(events.schema).parquet(source), folder, ck, late="400 days").awaitTermination()
    got, want = usage.current_counts(spark, folder), usage.period_counts(events)
    assert rows(got) == rows(want) and not got.where("final").count()
    assert rows(usage.top_of_periods(got, 2)) == rows(usage.top_of_periods(want, 2))
    assert {r.period for r in want.collect()} == {"day", "week", "month", "year", "ever"}


def test_late_events_and_timers(spark, tmp_path):
    """A period ends when the watermark passes it; what comes later for it is dropped, and all time goes on."""
    schema = "ts timestamp, event_type string, user_id long"
    source, folder, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    batches = [["2024-01-01 10:00:00", "2024-01-01 11:00:00"], ["2024-01-09 10:00:00"], ["2024-01-01 12:00:00", "2024-01-09 11:00:00"], [None]]
    for b in batches:
        spark.createDataFrame([(t, "a", 1) for t in b], "ts string, event_type string, user_id long").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(source)
        usage.keep_counts(spark.readStream.schema(schema).parquet(source), folder, ck, late="1 day").awaitTermination()
    got = {(r.period, str(r.start)): (r.n, r.final) for r in usage.current_counts(spark, folder).collect()}
    assert got[("day", "2024-01-01")] == (2, True) and got[("week", "2024-01-01")] == (2, True)
    assert got[("day", "2024-01-09")] == (2, False) and got[("month", "2024-01-01")][1] is False
    assert got[("ever", "None")] == (4, False)  # the late event is dropped before it is counted anywhere
