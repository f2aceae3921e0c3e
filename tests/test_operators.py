"""Small literal cases: indexes, filters, groups, cut-offs, suggestions, properties of matching."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from factloom.functions import text as T
from factloom.model import Entity, Pattern, Query, Var, Vocabulary
from factloom.operators import indexing, matching, results, scoring, statistics, suggest

P = "document_id long, document_collection string, subject_id string, subject_type string, relation string, object_id string, object_type string"


def preds(spark, rows):
    return spark.createDataFrame([(d, c, s, "AT", r, o, "BT") for d, c, s, r, o in rows], P)


def test_index_and_delta_agree(spark):
    old = [(1, "T", "A", "T1", "B"), (1, "T", "A", "T2", "B"), (1, "T", "A", None, "B")]
    new = [(2, "T", "A", "T1", "B"), (2, "T", "A", "T1", "B"), (2, "T", "A", "T3", "B"), (3, "U", "A", "T1", "B")]
    full = indexing.predication_index(preds(spark, old + new))
    merged = indexing.merge_postings(indexing.predication_index(preds(spark, old)), preds(spark, new), indexing.FACT_KEY)
    found = {(r.document_collection, r.relation): (r.document_ids, r.n) for r in merged.collect()}
    assert found == {("T", "T1"): ([2, 1], 2), ("T", "T2"): ([1], 1), ("T", "T3"): ([2], 1), ("U", "T1"): ([3], 1)}
    assert sorted(map(tuple, full.select(*merged.columns).collect()), key=repr) == sorted(map(tuple, merged.collect()), key=repr)


def test_posting_blocks(spark):
    rows = preds(spark, [(i, "T", "A", "r", "B") for i in (1, 9, 10, 19, 25)])
    index = indexing.predication_index(rows, block=10)
    assert {r.block: r.document_ids for r in index.collect()} == {0: [9, 1], 1: [19, 10], 2: [25]}
    assert [r.support for r in indexing.supports(index, indexing.FACT_KEY).collect()] == [5]
    changed = indexing.changed_postings(index, preds(spark, [(12, "T", "A", "r", "B"), (31, "T", "A", "r", "B")]), indexing.FACT_KEY, block=10)
    assert {r.block: r.document_ids for r in changed.collect()} == {1: [19, 12, 10], 3: [31]}


def test_latest_documents(spark):
    rows = spark.createDataFrame([(c, i) for c in "TU" for i in range(0, 400, 3)], "document_collection string, document_id long")
    got = matching.latest_documents(rows, 25, block=16).groupBy("document_collection").agg({"document_id": "min", "*": "count"}).collect()
    assert [(r[1], r[2]) for r in got] == [(399 - 3 * 24, 25)] * 2 or [(r[2], r[1]) for r in got] == [(399 - 3 * 24, 25)] * 2


def test_rounding_like_python(spark):
    import random

    rng = random.Random(3)
    xs = [0.125, 2.675, 0.375, 0.005, 0.015, -0.125, 0.0, 1.0, 0.995] + [rng.random() for _ in range(300)] + [k / 8 for k in range(40)] + [rng.random() * 1000 for _ in range(100)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r.y for r in df.select(T.rounded(df.x).alias("y")).collect()] == [round(x, 2) for x in xs]


def test_single_variable():
    assert results.single_variable(Query((Pattern((Var("S"),), "r", (Entity("B", "BT"),)),))) == "S"
    for q in (Query(()), Query((Pattern((Var("S"),), "r", (Var("O"),)),))):
        with pytest.raises(ValueError):
            results.single_variable(q)


def test_variables_keep_all_documents(spark):
    """However many documents of a collection match; a number is for callers that ask for the latest."""
    n = 1_600_000
    rows = spark.range(n).selectExpr("id AS document_id", "'T' AS document_collection", "'A' AS subject_id", "'AT' AS subject_type", "'r' AS relation", "'B' AS object_id", "'BT' AS object_type")
    q = Query((Pattern((Var("S", None),), "r", (Entity("B", "BT"),)),))
    assert matching.match(rows, q, Vocabulary()).count() == n
    assert matching.match(rows.where("document_id < 50"), q, Vocabulary(), latest=20).agg({"document_id": "min"}).first()[0] == 30


def titles(spark):
    rows = ["This is a Test", "hello test", "A test and more", "no such thing e", "test"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, title string")


@pytest.mark.parametrize("text, n", [("test", 4), ("*e*", 5), ("test and hello", 1), ("thing or hello", 2), ("(thing or hello) and test", 1), ("such+thing", 1), ("is+test", 0), ("TEST more", 1), ("", 5), ("a test or such thing", 3), ("this is or hello", 2), ("hello or test and more", 2), ("test and not more", 3), ('"such thing"', 1)])
def test_title_filter(spark, text, n):
    assert results.by_title(titles(spark), text).count() == n


@pytest.mark.parametrize("text", ["(test", "test)", "test or )", "(test) and more)"])
def test_malformed_title_filter(spark, text):
    with pytest.raises(ValueError):
        results.by_title(titles(spark), text)


def test_years(spark):
    rows = spark.createDataFrame([(y,) for y in (2020, 2021, 2022, 2023, 2024, 0)], "publication_year int")
    assert results.by_year(rows, 2018, 0).count() == 5
    assert results.by_year(rows, 2018, 2022).count() == 3
    hist = results.year_histogram(rows.where("publication_year <> 2022"))
    assert {r.year: r.n for r in hist.collect()} == {2020: 1, 2021: 1, 2022: 0, 2023: 1, 2024: 1}
    assert results.year_histogram(rows.where("false")).count() == 0


def test_classes(spark):
    rows = spark.createDataFrame([(["a"],), (None,), (["c"],), (None,), (["a", "b"],)], "classifications array<string>")
    assert [results.by_classes(rows, w).count() for w in (["a"], ["b"], ["c"], ["d"], [])] == [2, 1, 1, 0, 5]


def test_terms(spark):
    df = spark.createDataFrame([("The Drug-A,  of\nNew (x)",)], "t string")
    assert set(df.select(T.terms(df.t).alias("x")).first().x) == {"drug-a,", "drug", "of\nnew", "new", "(x)", "x"} - {"new"} | {"of\nnew"}


def test_authors_and_short_texts(spark):
    df = spark.createDataFrame([("a | b | c | d | e | f | g", "x" * 20)], "a string, t string")
    r = df.select(T.first_authors(df.a).alias("a"), T.shortened(df.t, 5).alias("t")).first()
    assert r.a == "a | b | c | d | e | 2+" and r.t == "xxxxx[...]"


def test_tree_equals_a_counter(spark):
    import random

    rng = random.Random(5)
    rows = [(i, "T", str(rng.randint(0, 5)), "t", str(rng.randint(0, 5)), "t") for i in range(2000)]
    df = spark.createDataFrame(rows, "document_id int, document_collection string, X_id string, X_type string, Y_id string, Y_type string")
    assert {(r.X_id, r.Y_id): r.n for r in results.tree_level(df, ["X", "Y"]).collect()} == Counter((r[2], r[4]) for r in rows)
    assert {r.X_id: r.n for r in results.tree_level(df, ["X"]).collect()} == Counter(r[2] for r in rows)
    assert sum(r.n for r in results.flat_groups(df, ["X", "Y"]).collect()) == 2000


def test_path_compression():
    assert results.compress({"D": 3, "D.1": 3, "D.1.2": 3}, {"D.1.2"}) == {"D": "D.1.2", "D.1": "D.1.2", "D.1.2": "D.1.2"}


@pytest.mark.parametrize("scores, expected", [([5.0] * 200, 50), ([9.0] * 40 + [5.0] * 30 + [1.0] * 50, 70), ([9.0] * 40 + [5.0] * 90 + [1.0] * 5, 100), ([float(-i) for i in range(90)], 51), ([1.0] * 10, 10)])
def test_dynamic_cutoff(spark, scores, expected):
    df = spark.createDataFrame([("T", i, s) for i, s in enumerate(scores)], "document_collection string, document_id long, score double")
    assert scoring.dynamic_cutoff(df).count() == expected


def test_schema_support(spark):
    rows = preds(spark, [(1, "T", "A", "T1", "B"), (1, "T", "C", "T1", "B"), (2, "T", "A", "T1", "B"), (2, "T", "A", "T2", "B"), (3, "T", "A", "T1", "B"), (3, "T", "A", "T2", "B"), (4, "T", "A", None, "B")])
    assert {r.relation: r.support for r in statistics.schema_support(rows).collect()} == {"T1": 3, "T2": 2}


def test_trials(spark):
    t = spark.createDataFrame([("a|b", "x", "PHASE1"), ("a", "x|y", "PHASE2|PHASE3"), ("zzz", "x", "PHASE4"), ("b", "y", "NA")], "interventions string, conditions string, phases string")
    drugs, diseases = spark.createDataFrame([("A", "d1"), ("b", "d2")], "name string, entity_id string"), spark.createDataFrame([("X", "s1"), ("y", "s2")], "name string, entity_id string")
    assert {(r.drug, r.disease): r.phase for r in statistics.trial_phases(t, drugs, diseases).collect()} == {("d1", "s1"): 3, ("d1", "s2"): 3, ("d2", "s1"): 1, ("d2", "s2"): -1}


def test_suggest(spark):
    assert suggest.word_orders("A B C") == ["A B C", "A C B", "B A C", "B C A", "C A B", "C B A"] and suggest.word_orders("Test For X") == ["Test For X"]
    assert [len(suggest.word_orders(x)) for x in ("t1 t2 And t3 t4", "t1 Or t2 Or t3", "t1 Or t2 And t3 t4")] == [8, 6, 12]
    assert suggest.explanation(["Diabetes Mellitus", "Diabetes Meitus", "Diabetes Mellitus, Congenital"], 5) == ["Diabetes Meitus", "Diabetes Mellitus"]
    assert suggest.explanation(["Ace", "Acetabulum"], 1) == ["Ace", "and 1 more"]
    assert suggest.complete_variable("?x(Dr", ["Drug", "Disease"]) == ["?x(Drug)"]
    terms = spark.createDataFrame([("diabetes",), ("Diab",), ("diabetics",), ("metformin",)], "term string")
    assert [r.term for r in suggest.complete(terms, "treats. diab").collect()] == ["Diab", "diabetes", "diabetics"]
    assert suggest.complete(terms, "d").count() == 0


def test_tagger(spark):
    names = ["Diabetes Mellitus", "Diabetes Mellitus Type 1", "Diabetes Mellitus, Type II", "Diabetic Type 2", "Mellitus"]
    v = spark.createDataFrame([(str(i), "Disease", None, n) for i, n in enumerate(names)], "entity_id string, entity_type string, entity_class string, synonym string")
    index = indexing.tagger_index([v])
    count = lambda q: indexing.find_entities(index, q).count()
    assert [count(q) for q in ("Diabetes", "mellitus diabetes", "Type-II", "diab typ 2", "nothing")] == [3, 3, 1, 1, 0]
    with pytest.raises(ValueError):
        count("ab")


ROWS = st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["T", "U"]), st.sampled_from("ABC"), st.sampled_from(["treats", "inhibits"]), st.sampled_from("XYZ")), min_size=1, max_size=14)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS)
def test_shared_variable_like_sets(spark, rows):
    q = Query((Pattern((Var("S"),), "treats", (Entity("X", "BT"), Entity("Y", "BT"))), Pattern((Var("S"),), "inhibits", (Var("O"),))))
    got = {tuple(r) for r in matching.match(matching.facts(preds(spark, rows)), q, Vocabulary()).select("document_collection", "document_id", "S_id", "O_id").collect()}
    first = {(c, d, s) for d, c, s, r, o in rows if r == "treats" and o in "XY"}
    second = {(c, d, s) for d, c, s, r, o in rows if r == "inhibits"}
    both = first & second
    enough = Counter((c, s) for c, _, s in both)
    assert got == {(c, d, s, o) for c, d, s in both if enough[c, s] > 1 for d2, c2, _, r, o in rows if r == "inhibits" and (d2, c2) == (d, c)}
