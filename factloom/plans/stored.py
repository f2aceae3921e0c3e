"""The pattern queries answered from a stored index, which is written once a session and folder of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stored
from ..sources import shared, star
from . import patterns

SLOTS = 4
NAMES = [
    "pattern_constant", "pattern_any_relation", "pattern_in_entities", "pattern_type_only", "pattern_expanded_interacts", "pattern_symmetric", "pattern_conjunction", "pattern_unsatisfiable", "pattern_flipped", "var_single", "var_both_sides",
    "var_shared_min2", "var_shared_no_min", "var_shared_full", "var_three_patterns", "var_two_product", "var_two_joint", "var_class_name", "filter_terms", "filter_entities", "no_statement_query", "latest_n_guard", "doc_ids", "type_expansion", "substituted_variable", "sub_count", "sub_count_topk",
]


def _statements(spark, d):
    """Statements dealt by the blocks of the index, whose lists are then made where they are."""
    return star.predication(spark, d, stored.BITS)


def index(spark, d):
    return shared.once(spark, "index", d, lambda path: stored.write(_statements(spark, d), path, SLOTS), lambda path: stored.Index(spark, path))


def _match(spark, d, query, vocabulary=patterns.V, **options):
    return index(spark, d).answer(query, vocabulary, **options)


def stored_lists(spark, d):
    """The whole index as it is stored, documents in order."""
    rows = stored.documents(index(spark, d).rows.where(F.col("order") == stored.OBJECT), "subject_id", "relation", "object_id")
    return rows.groupBy("document_collection", "subject_id", "relation", "object_id").agg(F.count("*").alias("n"), F.sum("document_id").alias("total"))


QUERIES = {f"stored_{n}": (lambda s, d, q=patterns.QUERIES[n]: q(s, d, match=_match)) for n in NAMES} | {"stored_lists": stored_lists}
ORACLE = {f"stored_{n}": patterns.ORACLE[n] for n in NAMES} | {
    "stored_lists": star.sql("SELECT document_collection, subject_id, relation, object_id, count(*) AS n, CAST(sum(document_id) AS BIGINT) AS total FROM facts GROUP BY ALL"),
}
