"""Every query of the engine's own operators against its SQL."""

import pytest
from helpers_oracle import SF, connection, oracle_rows, rows_of

from factloom.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == oracle_rows(connection(), ORACLE[name])


def test_concept_core_of_all_documents(spark):
    one, all_ = (QUERIES[n](spark, SF) for n in ("concept_core", "concept_core_all"))
    assert all_.select("document_id").distinct().count() > one.select("document_id").distinct().count() > 1
    assert one.join(all_, ["document_id", "ent_id", "score"], "left_anti").count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
