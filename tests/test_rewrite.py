"""Typing, order, duplicates and expansion of patterns."""

import pytest

from factloom.model import ANY, Entity, Pattern, Query, Var, Vocabulary, alternatives, rewrite
from factloom.operators import matching

DRUG, DISEASE, GENE = Entity("a", "Drug"), Entity("b", "Disease"), Entity("c", "Gene")
V = Vocabulary(typing={"treats": (frozenset({"Drug"}), frozenset({"Disease"})), "inhibits": (frozenset({"Drug"}), frozenset({"Gene"}))})


def one(s, r, o):
    return Query((Pattern((s,), r, (o,)),))


def test_flips_to_the_allowed_direction():
    assert rewrite(one(DISEASE, "treats", DRUG), V) == one(DRUG, "treats", DISEASE)


def test_impossible_types():
    assert rewrite(one(GENE, "inhibits", GENE), V) is None
    both = Query((Pattern((GENE,), "inhibits", (GENE,)), Pattern((DRUG,), "treats", (DISEASE,))))
    assert rewrite(both, V) is None
    assert rewrite(both, V, any_of=True) == one(DRUG, "treats", DISEASE)


def test_endpoints_outside_the_types_go():
    q = Query((Pattern((DRUG, GENE), "treats", (DISEASE,)),))
    assert rewrite(q, V).patterns[0].subjects == (DRUG,)


def test_untyped_variables_fit_anywhere():
    assert rewrite(one(Var("X"), "treats", DISEASE), V) is not None
    assert rewrite(one(Var("X", "Gene"), "treats", DISEASE), V) is None


def test_duplicates_go_and_constants_come_first():
    q = Query((Pattern((Var("X"),), "treats", (DISEASE,)), Pattern((DRUG,), "treats", (DISEASE,)), Pattern((DRUG,), "treats", (DISEASE,))))
    assert [len(p.variables()) for p in rewrite(q, V).patterns] == [0, 1]


def test_symmetric_order():
    assert rewrite(one(Entity("b", "T"), "induces", Entity("a", "T")), V) is None
    assert rewrite(one(Entity("a", "T"), "induces", Entity("b", "T")), V) is not None
    assert rewrite(one(Entity("b", "T"), ANY, Entity("a", "T")), V) is not None


def test_expansion():
    assert V.relations("interacts") == ["interacts", "metabolises", "inhibits"] and V.mirrored("interacts")
    assert V.relations("inhibits") == ["inhibits"] and not V.mirrored("inhibits")
    assert V.relations(ANY) is None and V.mirrored(ANY)


def test_alternatives_and_key():
    q = Query((Pattern((DRUG, GENE), "treats", (DISEASE,)), Pattern((DRUG,), ANY, (DISEASE, GENE))))
    assert len(alternatives(q)) == 4
    assert Query(q.patterns[::-1]).key() == q.key()
    assert one(Var("X"), "treats", DISEASE).bound({"X": DRUG}) == one(DRUG, "treats", DISEASE)


def test_needs_something(spark):
    facts = spark.createDataFrame([], "document_collection string, document_id long, subject_id string, subject_type string, relation string, object_id string, object_type string")
    with pytest.raises(ValueError):
        matching.match(facts, Query(), V)
    assert matching.match(facts, one(GENE, "inhibits", GENE), V).count() == 0
    with pytest.raises(ValueError):
        matching.known_collections(["a"], ["b"])
