"""Ranks without windows, and names as they are shown."""

import random

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import ranks, results


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, id long")
    got = {r.id: r.rank for r in ranks.ranked(df, ["g"], [F.desc("x"), F.asc("id")], "rank").collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    places = sorted((r.place, r.x, r.id) for r in ranks.placed(df, [F.asc("x"), F.asc("id")], "place").collect())
    assert [p for p, _, _ in places] == list(range(500)) and [(x, i) for _, x, i in places] == sorted((x, i) for _, x, i in rows)
    assert ranks.ranked(df.limit(0), ["g"], [F.asc("x")], "rank").collect() == []


def test_sorted_groups(spark):
    rows = [("r1", "n1", 1, 2000, 1), ("r1", "n1", 2, 2001, 1), ("r1", "n2", 3, 2000, 5), ("r2", "n3", 4, 1999, 1)]
    got = results.sorted_groups(spark.createDataFrame(rows, "top string, sub string, document_id long, publication_year int, publication_month int"), ["top", "sub"])
    assert sorted((r.document_id, r.top_rank, r.sub_rank, r.document_rank) for r in got.collect()) == [(1, 1, 1, 2), (2, 1, 1, 1), (3, 1, 2, 1), (4, 2, 1, 1)]


def test_names_as_they_are_shown(spark):
    rows = spark.createDataFrame([("DIABETES, type ii",), ("aspirin",), ("",), (None,)], "name string")
    assert [r.n for r in rows.select(T.normal_name(F.col("name")).alias("n")).collect()] == ["Diabetes Type Ii", "Aspirin", "", None]
