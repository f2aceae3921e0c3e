"""Columns of the input keep their values, whatever their names."""

from pyspark.sql import functions as F

from factloom.llm import ngram_join


def test_representatives_keep_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "x", "y", 5), (2, text + " more", "z", None, 6), (3, "something else", "q", "r", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string, __ROW_ string, `__maybe` int")
    got = ngram_join.representatives(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
    assert ngram_join.representatives(df.where(F.lit(False))).collect() == []
