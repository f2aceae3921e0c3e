"""Keyword scoring: similarity, suppression, odd texts."""

import pytest

from factloom.operators import keywords

TEXT = "Aspirin helps. In trials Aspirin helped many people with headache; headache went away. NASA tested Aspirin and aspirins.\nNothing else mattered."


def test_jaro():
    # Examples of the literature.
    for a, b, want in (("martha", "marhta", 0.944), ("dixon", "dicksonx", 0.767), ("dwayne", "duane", 0.822), ("jones", "johnson", 0.790), ("abc", "xyz", 0.0), ("", "a", 0.0), ("a", "a", 1.0)):
        assert keywords.jaro(a, b) == pytest.approx(want, abs=0.0006)


def test_alike_terms_go():
    assert keywords.unlike(["aspirin", "aspirins", "headache", "headaches", "x"], 3, 0.9) == ["aspirin", "headache", "x"]
    assert keywords.unlike(["aspirin", "aspirins"], 3, 0.99) == ["aspirin", "aspirins"]


def test_documents(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "the of and"), (5, "One"), (6, "word " * 50_000 + ". Rare words here"), (7, TEXT), (7, TEXT)], "document_id long, text string")
    rows = keywords.document_keywords(df, ["document_id"]).collect()
    own = {i: [r.term for r in sorted((r for r in rows if r.document_id == i), key=lambda r: r.rank)] for i in range(1, 8)}
    assert own[1][0] == "aspirin" and own[1].index("headache") < own[1].index("nothing") and "aspirins" not in own[1]
    assert own[2] == own[3] == own[4] == [] and own[5] == ["one"]
    assert own[6][0] == "word" and set(own[6]) == {"word", "rare"}  # words is alike to word
    assert own[7][0] == "aspirin"
    assert keywords.document_keywords(df.limit(0), ["document_id"]).collect() == []
