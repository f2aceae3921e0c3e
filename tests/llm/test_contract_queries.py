"""Contract queries against SQL or plain Python over the smallest tables, and the pipeline over a fixture."""

import hashlib

import pytest
from helpers_oracle import SF, connection, oracle_rows, rows_of

from factloom.llm import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == oracle_rows(connection(), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op5_suffix_dedup"}))
def test_one_row_a_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES[name](spark, SF)
    assert got.select("doc_id").distinct().count() == docs.count() == got.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_join", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r.doc_id: r.text for r in docs.collect()})
        assert set(seen[-1].items()) <= set(seen[-2].items())
    gone = set(seen[0]) - set(seen[1])
    assert sum(labels.get(i) == 0 for i in gone) <= 2
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    assert len(seen[2]) == len({fold(t) for t in seen[1].values()})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count()
    assert all(r.decoded_sha256 == hashlib.sha256((seen[0][r.doc_id] or "").encode()).hexdigest() for r in last)
