"""Top-k search by block bounds against scoring everything."""

import random

import pytest

from factloom.operators import scoring, topk

TAGS = "document_collection string, document_id long, ent_id string, ent_type string"


def corpus(spark, n, seed):
    rng = random.Random(seed)
    docs = {(rng.choice("XY"), i): rng.sample(range(30), rng.randrange(1, 9)) for i in range(n)}
    tags = spark.createDataFrame([(*d, f"e{e}", "T") for d, es in docs.items() for e in es], TAGS)
    weights = {d: {e: rng.choice([0.5, 1.0, 2.0, rng.random()]) for e in es} for d, es in docs.items() if d[1] % 20 == 0}
    core = spark.createDataFrame([(*d, f"e{e}", "T", w) for d, es in weights.items() for e, w in es.items()], "query_collection string, query_id long, ent_id string, ent_type string, score double")
    return docs, weights, tags, core


@pytest.mark.parametrize("seed", range(2))
def test_same_as_scoring_all(spark, seed):
    docs, weights, tags, core = corpus(spark, 600, seed)
    kept, low, came = topk.search(core, tags, 20, scoring.QUERY, block=16, batch=7)
    got, lows = {}, {(r.query_collection, r.query_id): r.low for r in low.collect()}
    for r in kept.collect():
        got.setdefault((r.query_collection, r.query_id), []).append((r.score, r.document_id, r.document_collection))
    assert set(got) == set(weights)
    for q, own in weights.items():
        every = [(round(sum(own[e] for e in sorted(own) if e in es) / sum(own.values()), 6), d[1], d[0]) for d, es in docs.items() if set(es) & set(own)]
        best = sorted(every, reverse=True)[:20]
        assert sorted(got[q], reverse=True) == best
        assert (lows[q] < best[-1][0]) == (min(every)[0] < best[-1][0])
    assert len(came) > 2


def test_rows_that_come_out_of_scoring(spark):
    """Eight times the documents are eight times the queries: scoring everything gives 64 times the rows, the search about eight times and one round more."""
    came, all_ = [], []
    for n in (400, 3200):
        docs, weights, tags, core = corpus(spark, n, 5)
        rounds = topk.search(core, tags, 20, scoring.QUERY, block=64)[2]
        assert all(r <= len(weights) * 20 * topk.GROWTH * (k + 1) for k, r in enumerate(rounds))
        came.append(sum(rounds) / len(rounds))
        all_.append(scoring.first_stage(core, tags, per=scoring.QUERY).count())
    assert all_[1] > 40 * all_[0]
    assert came[1] < 20 * came[0] and sum(rounds) < all_[1] / 2


def test_no_query_and_no_document(spark):
    _, _, tags, core = corpus(spark, 50, 1)
    for c, t in ((core.limit(0), tags), (core, tags.limit(0))):
        kept, low, came = topk.search(c, t, 5, scoring.QUERY)
        assert kept.collect() == low.collect() == came == []
