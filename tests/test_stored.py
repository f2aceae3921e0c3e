"""The stored index: layout, what is read, answers on random graphs against the statements themselves."""

import random

import pytest

from factloom.model import ANY, Entity, Pattern, Query, Var, Vocabulary
from factloom.operators import matching, stored

SCHEMA = "document_id long, document_collection string, subject_id string, subject_type string, relation string, object_id string, object_type string"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    rng = random.Random(4)
    kinds = {f"e{i}": "ABC"[i % 3] for i in range(12)}
    rows = []
    for _ in range(3000):
        s, o = rng.choice(sorted(kinds)), rng.choice(sorted(kinds))
        rows.append((rng.choice([rng.randrange(200), 32767 + rng.randrange(4), 10**9 + rng.randrange(50)]), rng.choice("XY"), s, kinds[s], rng.choice(["treats", "inhibits", "interacts", "metabolises", None]), o, kinds[o]))
    statements = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("stored") / "index")
    stored.write(statements, path, slots=3)
    return statements, stored.Index(spark, path)


def formatted(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def files_read(df):
    """Files that the scans of a query have opened."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    leaves = run.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def side(rng):
    if rng.random() < 0.4:
        return (Var(rng.choice("ST"), rng.choice([None, "A", "B"])),)
    return tuple(Entity(f"e{i}", "ABC"[i % 3]) for i in rng.sample(range(13), rng.choice([1, 1, 3])))


@pytest.mark.parametrize("seed", range(14))
def test_answers(graph, seed):
    statements, index = graph
    rng = random.Random(seed)
    q = Query(tuple(Pattern(side(rng), rng.choice([ANY, "treats", "inhibits", "interacts"]), side(rng)) for _ in range(rng.choice([1, 1, 2, 3]))))
    options = {"min_shared": rng.choice([1, 2, 3]), "joint": seed % 2 == 0}
    v = Vocabulary()
    want, got = matching.match(matching.statements(statements), q, v, **options), index.answer(q, v, **options)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_only_some_folders_and_blocks_are_read(graph):
    statements, index = graph
    v = Vocabulary()
    q = Query((Pattern((Entity("e1", "B"),), "treats", (Entity("e2", "C"),)),))
    answer = index.answer(q, v)
    plan = formatted(answer)
    filters = [x for x in plan.splitlines() if x.startswith("PartitionFilters")]
    assert filters and all("order#" in x and "relation#" in x and "slot#" in x for x in filters)
    assert "subject_id,e1" in plan and "object_id,e2" in plan  # pushed to the row groups
    assert "ExistingRDD" not in plan  # the statements are not read
    read, all_ = files_read(index.of(q.patterns[0], v)), files_read(index.rows)
    assert 0 < read < all_ / 5
    (own,) = stored.touched(index, q, v).collect()
    exact = {(r.document_collection, r.document_id >> 15, r.document_id) for r in statements.where("subject_id = 'e1' AND object_id = 'e2' AND relation = 'treats'").collect()}
    assert (own.lists, own.blocks, own.postings) == (len({x[:2] for x in exact}), len({x[:2] for x in exact}), len(exact))
    by_object = index.of(Pattern((Var("S"),), "treats", (Entity("e2", "C"),)), v)
    assert "(order#" in formatted(by_object) and "= object)" in formatted(by_object) and files_read(by_object) < all_ / 5


def test_collections_and_empty_tables(spark, graph, tmp_path):
    statements, index = graph
    q = Query((Pattern((Entity("e1", "B"),), ANY, (Var("O"),)),))
    assert {r.document_collection for r in index.answer(q, Vocabulary(), collections=["X"]).collect()} == {"X"}
    stored.write(statements.limit(0), str(tmp_path / "none"))
    assert stored.Index(spark, str(tmp_path / "none")).answer(q, Vocabulary()).collect() == []
    with pytest.raises(Exception, match="layout"):
        stored.Index(spark, str(tmp_path / "nowhere"))
