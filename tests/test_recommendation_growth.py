"""What must not grow with queries times documents, or with tokens: rows that are written."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers_oracle import rows_of

from factloom.operators import keywords, scoring, topk

TAGS = "document_collection string, document_id long, ent_id string, ent_type string"
CORE = "query_collection string, query_id long, ent_id string, ent_type string, score double"


def test_nothing_is_written_for_a_query_and_a_block(spark, monkeypatch):
    """Every block holds every entity, so that no bound of a block could tell it from others."""
    rng = random.Random(3)
    docs = [("X", i, rng.sample(range(8), 4)) for i in range(1600)]
    tags = spark.createDataFrame([(c, i, f"e{e}", "T") for c, i, es in docs for e in es], TAGS)
    core = spark.createDataFrame([(c, i, f"e{e}", "T", rng.random()) for c, i, es in docs if i % 20 == 0 for e in es], CORE)
    rows = []
    for name in ("cut", "written"):
        if hasattr(topk, name):

            def counted(*a, inner=getattr(topk, name)):
                rows.append((df := inner(*a)).count())
                return df

            monkeypatch.setattr(topk, name, counted)
    topk.search(core, tags, 5, scoring.QUERY, block=16)
    queries = 80
    assert sum(rows) < 2 * len(docs) + queries * 10  # blocks of 16 would make 8,000 pairs


@pytest.mark.parametrize("block, lists", [(1 << 18, 1024), (512, 7)])
def test_rare_entities_equal_documents_and_ids(spark, monkeypatch, block, lists):
    """Against scoring everything: lists as positions and as bits, copies of documents, ids in two collections, documents without a collection, queries of one entity."""
    monkeypatch.setattr(topk, "LISTS", lists)
    rng = random.Random(11)
    docs = {}
    for i in range(1500):
        es = frozenset(min(rng.randrange(200), rng.randrange(200), rng.randrange(200)) for _ in range(rng.randrange(1, 7)))
        for c in rng.choice([("X",), ("X", "Y"), (None,)]):
            docs[c, i] = es if i % 3 else frozenset({0, 1 + i % 2})
    tags = spark.createDataFrame([(*d, f"e{e}", "T") for d, es in docs.items() for e in es], TAGS)
    weights = {d: {e: rng.choice([0.25, 1.0, rng.random()]) for e in sorted(es)[: rng.randrange(1, 7)]} for d, es in docs.items() if d[1] % 50 == 0 and d[0]}
    core = spark.createDataFrame([(*d, f"e{e}", "T", w) for d, es in weights.items() for e, w in es.items()], CORE)
    kept, low, _ = topk.search(core, tags, 30, scoring.QUERY, block=block)
    got, lows = {}, {(r.query_collection, r.query_id): r.low for r in low.collect()}
    for r in kept.collect():
        got.setdefault((r.query_collection, r.query_id), []).append((r.score, r.document_id, r.document_collection))
    key = lambda x: (x[0], x[1], x[2] or "")
    for q, own in weights.items():
        every = sorted([(round(sum(own[e] for e in sorted(own) if e in es) / sum(own.values()), 6), d[1], d[0]) for d, es in docs.items() if es & set(own)], key=key, reverse=True)
        assert [(pytest.approx(s, abs=1.5e-6), i, c) for s, i, c in every[:30]] == sorted(got[q], key=key, reverse=True)
        assert (lows[q] < every[:30][-1][0] - 1e-6) == (every[-1][0] < every[:30][-1][0] - 1e-6)
    assert set(got) == set(weights)


def test_keywords_of_documents_make_no_row_of_a_token(spark):
    """Tokens are counted inside a task; the rows are those of the aggregates, also for odd texts, several texts of a key and keys without words."""
    rng = random.Random(2)
    words = "Aspirin aspirin aspirins NASA nasa trials Trials the of and 42 4x ÉCOLE école Straße STRASSE İzmir ΣΑΣ ﬁn ² ab x_y headache headaches don't".split()
    ends = [" ", " ", " ", ", ", ". ", "!? ", "\n", "...", "_", "-"]
    texts = [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(0, 120)))) for _ in range(150)]
    rows = [(i % 120, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, ".?!"), (203, "the of and"), (204, "One"), (None, "Lost words"), (205, ". start.mid. end")]
    df = spark.createDataFrame(rows, "k int, text string")
    found = keywords.document_keywords(df, ["k"])
    assert rows_of(found) == rows_of(keywords.suppressed(keywords.scored(df, ["k"]), ["k"]))
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_keywords_over_many_batches(spark, monkeypatch):
    """Texts of a key stay together where counting is cut into pieces."""
    texts = [(i // 3, f"Red gears {i % 7} turn. Blue gears stop {'again ' * (i % 5)}") for i in range(300)]
    expected = keywords.keywords_of([t for _, t in texts], np.array([k for k, _ in texts]), 25, 0.9)
    monkeypatch.setattr(keywords, "CHARACTERS", 100)
    of = keywords._counted(["k"], 25, 0.9)
    batches = [pa.RecordBatch.from_pydict({"k": [k for k, _ in part], "text": [t for _, t in part]}) for part in (texts[i : i + 70] for i in range(0, 300, 70))]
    out = list(of(iter(batches)))
    assert len(out) > 10
    assert [(k, t) for b in out for k, t in zip(b.column("k").to_pylist(), b.column("terms").to_pylist())] == [(k, t) for k, (t, _) in enumerate(expected)]
