"""Queries of the translation of query strings. The strings are those of the log and others made of names in the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import translation
from ..sources import star
from .indexes import _VOC, _index

RELATIONS = ["treats", "inhibits", "interacts", "interacts with", "associated"]
TYPES = {"nation": "Nation", "nations": "Nation", "brand": "Brand", "brands": "Brand", "product line": "Brand"}
STRINGS = """SELECT 'part' AS origin, p_partkey AS query_id, CASE p_partkey % 12
  WHEN 0 THEN concat(p_name, ' treats nation_', p_partkey % 25) WHEN 1 THEN concat('?X(Nations)  treats ', substr(p_name, 1, 6))
  WHEN 2 THEN concat('Nation interacts with "', p_name, '"') WHEN 3 THEN concat(p_name, ' inhibits ?Y _AND_ ?Y(Product) treats ', p_name)
  WHEN 4 THEN concat(p_name, ' treats ?Y_AND_ ?Y treats asi _AND_') WHEN 5 THEN concat('chembl', p_partkey, ' associated gene:', p_size)
  WHEN 6 THEN concat('treats ', p_name) WHEN 7 THEN concat(p_name, ' treats unknown thing') WHEN 8 THEN concat('product line treats treats ', p_name)
  WHEN 9 THEN concat('?(Nation) treats ', p_name) WHEN 10 THEN concat('NATION 1', ' interacts with interacts ', p_name) ELSE '  ' END AS query FROM part
UNION ALL SELECT 'log', event_id, event_type FROM events"""


def _strings(spark, d):
    views = {}
    for name in ("part", "events"):
        views[name] = star.table(spark, d, name)
    return spark.sql(STRINGS.replace("FROM part", "FROM {part}").replace("FROM events", "FROM {events}"), **views)


def _translated(spark, d):
    return translation.translate(_strings(spark, d), ["origin", "query_id"], _index(spark, d), RELATIONS, TYPES)


def translated_queries(spark, d):
    return _translated(spark, d)


def answerable_queries(spark, d):
    return translation.answerable(_translated(spark, d), ["origin", "query_id"])


def tagged_terms(spark, d):
    """Every two words of product names, in both orders, as search terms."""
    words = star.table(spark, d, "part").select(F.split("p_name", " ").alias("w"))
    terms = words.select(F.explode(F.array(F.concat(F.substring(F.col("w")[1], 1, 3), F.lit(" "), F.upper(F.substring(F.col("w")[0], 1, 2))), F.substring(F.col("w")[0], 1, 3), F.lit("zz"))).alias("term")).distinct()
    return translation.tagged(terms, translation.word_starts(_index(spark, d))).select("term", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["id"])), "|").alias("entities"))


_WORDS = lambda x: f"list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[[:punct:]]', ' ', 'g'), ' +', ' ', 'g')), ' ')), lambda w: w <> '')"
_TAGGED = lambda terms: f"SELECT term, array_to_string(list_sort(list(DISTINCT entity_type || ':' || entity_id)), '|') AS entities FROM (SELECT term, {_WORDS('term')} AS ws FROM (SELECT DISTINCT term FROM ({terms}))) t JOIN voc ON len(list_filter(ws, lambda w: NOT contains(synonym_processed, ' ' || w))) = 0 WHERE length(array_to_string(ws, '')) >= 3 GROUP BY term"
_TYPE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END"
_READ = f"""WITH voc AS MATERIALIZED ({{voc}}), strings AS ({STRINGS}),
parts AS (SELECT origin, query_id, fact, ps[fact] AS part FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS fact FROM (SELECT origin, query_id, list_filter(list_transform(string_split(trim(regexp_replace(query, '\\s+', ' ', 'g')), '_AND_'), lambda p: trim(replace(p, '"', ''))), lambda p: p <> '') AS ps FROM strings))),
rel AS (SELECT unnest({RELATIONS}) AS relation), tokens AS (SELECT *, string_split(part, ' ') AS ts FROM parts),
ways AS (SELECT * FROM (SELECT origin, query_id, fact, relation, n, i, array_to_string(ts[1:i - 1], ' ') AS s, array_to_string(ts[i + n:len(ts)], ' ') AS o, lower(array_to_string(ts[i:i + n - 1], ' ')) AS named, len(ts) AS total FROM (SELECT *, unnest(range(2, len(ts))) AS i FROM tokens), (SELECT relation, len(string_split(relation, ' ')) AS n FROM rel)) WHERE named = relation AND i + n <= total),
ends AS (SELECT DISTINCT s AS term FROM ways UNION SELECT o FROM ways),
sorted AS (SELECT term, lower(replace(term, '_', ' ')) AS low, regexp_extract(term, '\\?\\w+') AS name, lower(regexp_extract(term, '\\((\\w+/?\\w+?)\\)', 1)) AS kind FROM ends),
tags AS ({_TAGGED("SELECT term FROM ends")}),
known AS (SELECT sorted.term, CASE WHEN starts_with(sorted.term, '?') THEN CASE WHEN kind = '' THEN name ELSE name || '(' || {_TYPE.format('kind')} || ')' END
   WHEN starts_with(low, 'chembl') THEN 'Drug:' || upper(sorted.term) WHEN starts_with(low, 'gene:') THEN 'Gene:' || string_split(sorted.term, ':')[-1]
   WHEN {_TYPE.format('low')} IS NOT NULL THEN '?' || {_TYPE.format('low')} || '(' || {_TYPE.format('low')} || ')' ELSE entities END AS shown,
   CASE WHEN starts_with(sorted.term, '?') AND name = '' THEN 'variable without a name' WHEN starts_with(sorted.term, '?') AND kind <> '' AND {_TYPE.format('kind')} IS NULL THEN 'unknown type' END AS wrong FROM sorted LEFT JOIN tags ON tags.term = sorted.term),
judged AS (SELECT term, CASE WHEN wrong IS NULL THEN shown END AS shown, coalesce(wrong, CASE WHEN shown IS NULL THEN 'unknown term' END) AS reason FROM known),
read AS (SELECT w.*, a.shown AS subject, b.shown AS object, coalesce('subject: ' || a.reason, 'object: ' || b.reason) AS reason FROM ways w JOIN judged a ON a.term = s JOIN judged b ON b.term = o),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin, query_id, fact ORDER BY reason IS NOT NULL, n DESC, i) AS r FROM read) WHERE r = 1),
facts AS (SELECT p.origin, p.query_id, p.fact, CASE WHEN b.reason IS NULL THEN subject END AS subject, CASE WHEN b.reason IS NULL THEN relation END AS relation, CASE WHEN b.reason IS NULL THEN object END AS object,
   CASE WHEN b.origin IS NULL THEN 'no relation' ELSE b.reason END AS reason FROM parts p LEFT JOIN best b ON b.origin = p.origin AND b.query_id = p.query_id AND b.fact = p.fact),
every AS (SELECT * FROM facts UNION ALL SELECT origin, query_id, 0, NULL, NULL, NULL, 'empty' FROM strings s WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.origin = s.origin AND p.query_id = s.query_id))"""
_TERMS = "SELECT unnest([substr(w[2], 1, 3) || ' ' || upper(substr(w[1], 1, 2)), substr(w[1], 1, 3), 'zz']) AS term FROM (SELECT string_split(p_name, ' ') AS w FROM part)"


def _with_vocabulary(sql: str) -> str:
    fixtures = {k: v for k, v in star.FIXTURES.items() if k in _VOC}
    return sql.replace("WITH voc", "WITH " + "".join(f"{k} AS ({v}), " for k, v in fixtures.items()) + "voc").replace("{voc}", _VOC)


QUERIES = {"translated_queries": translated_queries, "answerable_queries": answerable_queries, "tagged_terms": tagged_terms}
ORACLE = {
    "translated_queries": _with_vocabulary(f"{_READ} SELECT * FROM every"),
    "answerable_queries": _with_vocabulary(f"{_READ} SELECT origin, query_id, count(*) FILTER (WHERE reason IS NULL) AS n_facts, arg_min(reason, fact) FILTER (WHERE reason IS NOT NULL) AS reason FROM every GROUP BY origin, query_id"),
    "tagged_terms": _with_vocabulary(f"WITH voc AS MATERIALIZED ({{voc}}) {_TAGGED(_TERMS)}"),
}
