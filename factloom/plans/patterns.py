"""Queries of pattern matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import ANY, Entity, Pattern, Query, Var, Vocabulary
from ..operators import indexing, matching
from ..sources import star

V = Vocabulary()
N = lambda *k: tuple(Entity(f"NATION_{i}", "Nation") for i in k)
B = lambda *k: tuple(Entity(f"Brand#{i}", "Brand") for i in k)
SEG = lambda s: (Entity(s, "Segment"),)
X = lambda name, type=None: (Var(name, type),)


def _facts(spark, d):
    return matching.facts(star.predication(spark, d))


def _statements(spark, d):
    return matching.statements(star.predication(spark, d))


def _raw(spark, d, query, vocabulary=V, **options):
    """Answers from the statements themselves. Queries take another function of this kind as ``match`` to be answered from elsewhere."""
    return matching.match(_statements(spark, d), query, vocabulary, **options)


def _answer(*patterns, **options):
    return lambda spark, d, match=_raw: match(spark, d, Query(patterns), V, **options)


def _meta(spark, d):
    return star.metadata(spark, d).join(star.document(spark, d).select("document_id", "document_collection", "title"), ["document_id", "document_collection"])


def pattern_constant(spark, d, match=_raw):
    return matching.with_metadata(_answer(Pattern(N(3), "treats", B(2)))(spark, d, match), _meta(spark, d))


def var_class_name(spark, d, match=_raw):
    members = tuple(Entity(e.id, e.type, "Continent") for e in N(0, 5, 10, 15, 20))
    return _answer(Pattern(members, "treats", B(2)))(spark, d, match).select("document_collection", "document_id", F.col("Continent_id").alias("class_member"), F.col("Continent_type").alias("class_type"))


def filter_terms(spark, d, match=_raw):
    docs = star.document(spark, d).withColumnRenamed("title", "text")
    q = Query((Pattern(N(3), ANY, X("A", "Brand")),), terms=("Building", "1-URGENT"))
    return match(spark, d, q, V, term_index=indexing.term_rows(docs))


def _tags(spark, d):
    return indexing.tag_rows(star.tag(spark, d))


def filter_entities(spark, d, match=_raw):
    q = Query((Pattern(X("S", "Nation"), "inhibits", B(2)),), entity_sets=(B(5, 7), N(3)))
    return match(spark, d, q, V, tag_index=_tags(spark, d))


def no_statement_query(spark, d, match=_raw):
    q = Query(entity_sets=(B(2), N(3, 4)), terms=("building",))
    return match(spark, d, q, V, term_index=indexing.term_rows(star.document(spark, d).withColumnRenamed("title", "text")), tag_index=_tags(spark, d))


def doc_ids(spark, d, match=_raw):
    return _answer(Pattern(N(3), ANY, B(2, 5)))(spark, d, match).select("document_id").distinct().orderBy("document_id")


SHARED = (Pattern(X("S", "Nation"), "treats", X("A")), Pattern(X("S"), "inhibits", X("B")))


def _shared(min_shared):
    return lambda spark, d, match=_raw: _answer(*SHARED, min_shared=min_shared)(spark, d, match).select("document_collection", "document_id", "S_id", "S_type").distinct()


def query_keys(spark, d):
    """The keys of a query for each product: its brand or type, treated by a nation, with the words of its name as terms."""

    def keys(frames):
        for f in frames:
            made = [Query((Pattern((Var("S", "Nation"),), "treats", (Entity(t, "Type"), Entity(b, "Brand"))),), terms=tuple(n.split(" "))).key() for b, t, n in zip(f["p_brand"], f["p_type"], f["p_name"])]
            yield f.assign(key=made)[["key"]]

    return star.table(spark, d, "part").select("p_brand", "p_type", "p_name").distinct().mapInPandas(keys, "key string").distinct()


QUERIES = {
    "pattern_constant": pattern_constant,
    "pattern_any_relation": _answer(Pattern(N(3), ANY, B(2))),
    "pattern_in_entities": _answer(Pattern(N(3, 5), "treats", B(2, 7))),
    "pattern_type_only": lambda s, d, match=_raw: _answer(Pattern(X("S", "Nation"), "induces", X("O", "Brand")))(s, d, match).select("document_collection", "document_id").distinct(),
    "pattern_expanded_interacts": _answer(Pattern(N(1), "interacts", B(3))),
    "pattern_symmetric": _answer(Pattern(B(3), "interacts", SEG("BUILDING"))),
    "pattern_conjunction": _answer(Pattern(N(3, 4, 5), ANY, B(2, 3, 4)), Pattern(SEG("BUILDING"), "interacts", B(5, 6, 7))),
    "pattern_unsatisfiable": lambda s, d, match=_raw: match(s, d, Query((Pattern(B(2), "treats", B(3)),)), Vocabulary(typing={"treats": (frozenset({"Nation"}), frozenset({"Brand"}))})),
    "pattern_flipped": lambda s, d, match=_raw: match(s, d, Query((Pattern(B(2), "treats", N(3)),)), Vocabulary(typing={"treats": (frozenset({"Nation"}), frozenset({"Brand"}))})),
    "var_single": _answer(Pattern(X("S", "Nation"), "treats", B(2))),
    "var_both_sides": _answer(Pattern(X("S"), "metabolises", X("S"))),
    "var_shared_min2": _shared(2),
    "var_shared_no_min": _shared(1),
    "var_shared_full": _answer(*SHARED),
    "var_three_patterns": lambda s, d, match=_raw: _answer(Pattern(N(*range(25)), "administered", B(2, 5, 7)), *SHARED)(s, d, match).select("document_collection", "document_id", "S_id").distinct(),
    "var_two_product": _answer(Pattern(X("S", "Nation"), "treats", X("O", "Brand"))),
    "var_two_joint": _answer(Pattern(X("S", "Nation"), "treats", X("O", "Brand")), joint=True),
    "var_class_name": var_class_name,
    "filter_terms": filter_terms,
    "filter_entities": filter_entities,
    "no_statement_query": no_statement_query,
    "latest_n_guard": _answer(Pattern(X("S", "Nation"), "treats", B(2)), latest=20),
    "doc_ids": doc_ids,
    "type_expansion": lambda s, d, match=_raw: match(s, d, Query((Pattern(X("S", "Place"), "treats", B(2)),)), Vocabulary(type_expansion={"Place": ["Nation", "Segment"]})),
    "substituted_variable": lambda s, d, match=_raw: match(s, d, Query((Pattern(X("S", "Nation"), "treats", X("O", "Brand")),)).bound({"S": N(3)[0]}), V),
    "answers_newest_first": lambda s, d, match=_raw: matching.newest_answers(_answer(Pattern(X("S", "Nation"), "treats", B(2, 3)))(s, d, match)),
    "query_keys": query_keys,
    "docs_for_entity": lambda s, d: _tags(s, d).where("ent_id = 'Brand#2' AND ent_type = 'Brand'").select("document_collection", "document_id"),
    "sub_count": lambda s, d, match=_raw: matching.substitution_counts(_answer(Pattern(X("S", "Nation"), ANY, B(2)))(s, d, match), "S"),
    "sub_count_topk": lambda s, d, match=_raw: matching.substitution_counts(_answer(Pattern(N(3), ANY, X("O", "Brand")))(s, d, match), "O", 5),
    "distinct_predicates": lambda s, d: _facts(s, d).select("document_collection", "relation").distinct(),
    "distinct_entities": lambda s, d: matching.entities(_statements(s, d)),
}

_DOCS = "SELECT DISTINCT document_collection, document_id FROM facts WHERE "
_NATIONS = "subject_type = 'Nation'"
_S = "SELECT DISTINCT document_collection, document_id, subject_id AS S_id, subject_type AS S_type FROM facts WHERE "
_TERMS = r"""SELECT DISTINCT document_collection, document_id, term FROM (SELECT document_collection, document_id, unnest(string_split(lower(title), ' ')) AS term FROM fx_document)"""
_T, _I = _S + "relation = 'treats' AND " + _NATIONS, _S + "relation = 'inhibits'"
_J2 = "SELECT * FROM (SELECT t.*, count(*) OVER (PARTITION BY t.document_collection, t.S_id, t.S_type) AS c FROM t JOIN i USING (document_collection, document_id, S_id, S_type)) WHERE c > 1"
ORACLE = {
    "pattern_constant": star.sql(f"SELECT DISTINCT document_collection, document_id, substr(title, 1, 500) AS title, journals, publication_year, publication_month FROM ({_DOCS} relation = 'treats' AND subject_id = 'NATION_3' AND object_id = 'Brand#2') JOIN fx_metadata USING (document_collection, document_id) JOIN fx_document USING (document_collection, document_id)"),
    "pattern_any_relation": star.sql(_DOCS + "subject_id = 'NATION_3' AND object_id = 'Brand#2'"),
    "pattern_in_entities": star.sql(_DOCS + "relation = 'treats' AND subject_id IN ('NATION_3', 'NATION_5') AND object_id IN ('Brand#2', 'Brand#7')"),
    "pattern_type_only": star.sql(_DOCS + "relation = 'induces' AND subject_type = 'Nation' AND object_type = 'Brand'"),
    "pattern_expanded_interacts": star.sql(_DOCS + "relation IN ('interacts', 'metabolises', 'inhibits') AND ((subject_id = 'NATION_1' AND object_id = 'Brand#3') OR (object_id = 'NATION_1' AND subject_id = 'Brand#3'))"),
    "pattern_symmetric": star.sql(_DOCS + "relation IN ('interacts', 'metabolises', 'inhibits') AND subject_id = 'BUILDING' AND object_id = 'Brand#3'"),
    "pattern_conjunction": star.sql(_DOCS + "subject_id IN ('NATION_3', 'NATION_4', 'NATION_5') AND object_id IN ('Brand#2', 'Brand#3', 'Brand#4') INTERSECT " + _DOCS + "relation = 'interacts' AND subject_id = 'BUILDING' AND object_id IN ('Brand#5', 'Brand#6', 'Brand#7')"),
    "pattern_unsatisfiable": star.sql(_DOCS + "false"),
    "pattern_flipped": star.sql(_DOCS + "relation = 'treats' AND subject_id = 'NATION_3' AND object_id = 'Brand#2'"),
    "var_single": star.sql(_S + "relation = 'treats' AND subject_type = 'Nation' AND object_id = 'Brand#2'"),
    "var_both_sides": star.sql("SELECT document_collection, document_id, subject_id AS S_id, subject_type AS S_type FROM facts WHERE relation = 'metabolises' UNION SELECT document_collection, document_id, object_id, object_type FROM facts WHERE relation = 'metabolises'"),
    "var_shared_min2": star.sql("SELECT document_collection, document_id, S_id, S_type FROM j", t=_T, i=_I, j=_J2),
    "var_shared_no_min": star.sql("SELECT document_collection, document_id, S_id, S_type FROM t JOIN i USING (document_collection, document_id, S_id, S_type)", t=_T, i=_I),
    "var_shared_full": star.sql("SELECT document_collection, document_id, S_id, S_type, A_id, A_type, B_id, B_type FROM j JOIN a USING (document_collection, document_id) JOIN b USING (document_collection, document_id)", t=_T, i=_I, j=_J2, a="SELECT DISTINCT document_collection, document_id, object_id AS A_id, object_type AS A_type FROM facts WHERE relation = 'treats' AND subject_type = 'Nation'", b="SELECT DISTINCT document_collection, document_id, object_id AS B_id, object_type AS B_type FROM facts WHERE relation = 'inhibits'"),
    "var_three_patterns": star.sql("SELECT DISTINCT document_collection, document_id, S_id FROM j SEMI JOIN (" + _DOCS + "relation = 'administered' AND object_id IN ('Brand#2', 'Brand#5', 'Brand#7')) USING (document_collection, document_id)", t=_T, i=_I, j=_J2),
    "var_two_product": star.sql("SELECT * FROM t JOIN o USING (document_collection, document_id)", t=_T, o="SELECT DISTINCT document_collection, document_id, object_id AS O_id, object_type AS O_type FROM facts WHERE relation = 'treats' AND subject_type = 'Nation'"),
    "var_two_joint": star.sql("SELECT DISTINCT document_collection, document_id, subject_id AS S_id, subject_type AS S_type, object_id AS O_id, object_type AS O_type FROM facts WHERE relation = 'treats' AND subject_type = 'Nation'"),
    "var_class_name": star.sql("SELECT DISTINCT document_collection, document_id, subject_id AS class_member, subject_type AS class_type FROM facts WHERE relation = 'treats' AND object_id = 'Brand#2' AND subject_id IN ('NATION_0', 'NATION_5', 'NATION_10', 'NATION_15', 'NATION_20')"),
    "filter_terms": star.sql("SELECT DISTINCT document_collection, document_id, object_id AS A_id, object_type AS A_type FROM facts SEMI JOIN (SELECT * FROM terms WHERE term = 'building') x USING (document_collection, document_id) SEMI JOIN (SELECT * FROM terms WHERE term = '1-urgent') y USING (document_collection, document_id) WHERE subject_id = 'NATION_3' AND subject_type = 'Nation'", terms=_TERMS),
    "filter_entities": star.sql(_S + "relation = 'inhibits' AND subject_type = 'Nation' AND object_id = 'Brand#2' AND (document_collection, document_id) IN (SELECT (document_collection, document_id) FROM fx_tag WHERE ent_id IN ('Brand#5', 'Brand#7')) AND (document_collection, document_id) IN (SELECT (document_collection, document_id) FROM fx_tag WHERE ent_id = 'NATION_3')"),
    "no_statement_query": star.sql("SELECT document_collection, document_id FROM fx_tag WHERE ent_id = 'Brand#2' INTERSECT SELECT document_collection, document_id FROM fx_tag WHERE ent_id IN ('NATION_3', 'NATION_4') INTERSECT SELECT document_collection, document_id FROM terms WHERE term = 'building'", terms=_TERMS),
    "latest_n_guard": star.sql("SELECT s.* FROM s JOIN (SELECT *, row_number() OVER (PARTITION BY document_collection ORDER BY document_id DESC) AS r FROM (SELECT DISTINCT document_collection, document_id FROM s)) USING (document_collection, document_id) WHERE r <= 20", s=_S + "relation = 'treats' AND subject_type = 'Nation' AND object_id = 'Brand#2'").replace("s.* FROM s", "s.document_collection, s.document_id, S_id, S_type FROM s"),
    "doc_ids": star.sql("SELECT DISTINCT document_id FROM facts WHERE subject_id = 'NATION_3' AND object_id IN ('Brand#2', 'Brand#5')"),
    "type_expansion": star.sql(_S + "relation = 'treats' AND subject_type IN ('Place', 'Nation', 'Segment') AND object_id = 'Brand#2'"),
    "substituted_variable": star.sql("SELECT DISTINCT document_collection, document_id, object_id AS O_id, object_type AS O_type FROM facts WHERE relation = 'treats' AND subject_id = 'NATION_3' AND object_type = 'Brand'"),
    "answers_newest_first": star.sql(_S + "relation = 'treats' AND subject_type = 'Nation' AND object_id IN ('Brand#2', 'Brand#3') ORDER BY document_id DESC"),
    "query_keys": "SELECT DISTINCT '?S(Nation) treats ' || array_to_string(list_sort(['Brand:' || p_brand, 'Type:' || p_type]), '|') || '; ' || array_to_string(list_sort(string_split(p_name, ' ')), '; ') AS key FROM part",
    "docs_for_entity": star.sql("SELECT DISTINCT document_collection, document_id FROM fx_tag WHERE ent_id = 'Brand#2'"),
    "sub_count": star.sql("SELECT subject_id AS S_id, subject_type AS S_type, count(DISTINCT (document_collection, document_id)) AS n FROM facts WHERE subject_type = 'Nation' AND object_id = 'Brand#2' GROUP BY ALL"),
    "sub_count_topk": star.sql("SELECT object_id AS O_id, object_type AS O_type, count(DISTINCT (document_collection, document_id)) AS n FROM facts WHERE subject_id = 'NATION_3' AND object_type = 'Brand' GROUP BY ALL ORDER BY n DESC, O_id LIMIT 5"),
    "distinct_predicates": star.sql("SELECT DISTINCT document_collection, relation FROM facts"),
    "distinct_entities": star.sql("SELECT subject_id AS ent_id, subject_type AS ent_type FROM facts UNION SELECT object_id, object_type FROM facts"),
}
