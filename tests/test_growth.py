"""What must not grow with the tables: rows that are shuffled, files, rows of one key in a task."""

import re

import duckdb
from helpers_oracle import SF, oracle_rows, rows_of
from pyspark.sql import functions as F

from factloom.model import Entity, Query, Vocabulary
from factloom.operators import dictionary, indexing, keywords, matching, scoring, stored, translation
from factloom.plans import analytics, indexes, lookups
from factloom.plans import stored as stored_plans
from factloom.sources import star, tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_keywords_of_documents_shuffle_texts_only(spark):
    texts = spark.range(50).select(F.col("id").alias("document_id"), F.concat(F.lit("Blue gears turn. Red gears stop "), F.col("id").cast("string")).alias("text"))
    logical, physical = plan(keywords.document_keywords(texts, ["document_id"]))
    assert "Expand" not in logical  # a copy of each token for every distinct count
    above = physical[: physical.rindex("Generate")]
    assert "Exchange" in physical and "Exchange hashpartitioning(document_id" not in above.split("SortMergeJoin")[0]
    assert "term" not in "".join(line for line in physical.splitlines() if "Exchange" in line)


def test_concept_core_keeps_concepts_of_any_support(spark):
    rows = spark.createDataFrame([("C", 1, "x", 2_000_000, 0.5), ("C", 1, "y", 3, 0.25), ("C", 1, "z", 3, 0.0)], "document_collection string, document_id long, ent_id string, support long, score double")
    assert {r.ent_id for r in scoring.concept_core(rows).collect()} == {"x", "y"}
    assert {r.ent_id for r in scoring.concept_core(rows, scoring.MAX_SUPPORT).collect()} == {"y"}


def exchanges(df):
    df.collect()
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Exchange " in line and "Broadcast" not in line]


def test_documents_are_brought_together_once(spark):
    """Lines are shuffled once for a document's mentions or statements, whatever is grouped or joined by document afterwards."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")
    try:
        lines = [x for x in exchanges(scoring.positions(star.tag(spark, SF))) if "l_orderkey" in x or "document_id" in x]
        assert len(lines) == 1
        joined = tables.as_documents(star.document(spark, SF), star.tag(spark, SF), star.predication(spark, SF))
        assert len([x for x in exchanges(joined) if "hashpartitioning(l_orderkey" in x]) == 2
        assert not [x for x in exchanges(joined) if "hashpartitioning(document_collection" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_without_a_supplier_or_customer(spark, tmp_path):
    for name in ("nation", "part", "orders", "lineitem"):
        star.table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, key in (("supplier", "s_suppkey"), ("customer", "c_custkey")):
        star.table(spark, SF, name).where(F.col(key) % 2 == 0).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("nation", "part", "orders", "lineitem", "supplier", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("tag", "predication"):
        assert rows_of(getattr(star, name)(spark, str(tmp_path))) == oracle_rows(con, star.FIXTURES[f"fx_{name}"])


def test_documents_are_written_compressed(spark, tmp_path):
    tables.write_documents(spark.range(3).select(F.col("id"), F.lit("x").alias("title")), str(tmp_path / "d"))
    assert list((tmp_path / "d").glob("*.json.gz")) and not list((tmp_path / "d").glob("*.json"))
    assert tables.read_documents(spark, str(tmp_path / "d"), "C").count() == 3


def test_the_dictionary_has_a_bounded_number_of_files(spark, tmp_path):
    dictionary.write(spark.range(1000).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("term")), str(tmp_path / "d"), per_file=2, per_block=4)
    own = dictionary.Dictionary(spark, str(tmp_path / "d"))
    assert len(own.bounds) <= dictionary.MOST_FILES
    assert [r.term for r in own.complete("name 99").collect()] == ["name 99", *[f"name 99{i}" for i in range(9)]]
    assert own.terms().count() == 1000


def test_strings_without_a_relation_are_not_looked_up(spark):
    index = spark.createDataFrame([("b1", "Brand", "red gear", " red gear")], "entity_id string, entity_type string, synonym string, synonym_processed string")
    strings = spark.createDataFrame([(1, "click"), (2, "red gear treats red"), (3, " ")], "query_id long, query string")
    found = translation.translate(strings, ["query_id"], index, ["treats"], {})
    assert {(r.query_id, r.reason) for r in found.collect()} == {(1, "no relation"), (2, None), (3, "empty")}
    assert "Union" in plan(found)[0]  # read apart


def test_equal_titles_are_posted_once(spark):
    titles = star.document(spark, SF).select("title").distinct().count()
    assert lookups._search(spark, SF).postings.select("id").distinct().count() == titles < star.document(spark, SF).count()


def test_posting_lists_are_made_where_their_block_is(spark):
    """No partial list is shuffled, and lists are dealt once for both orders."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        statements = stored_plans._statements(spark, SF)
        physical = plan(stored.lists(statements))[1]
        assert "Exchange" in physical and "Exchange" not in physical[: physical.index("Generate")]
        same = statements.drop("block")
        assert rows_of(stored.lists(statements)) == rows_of(stored.lists(same))
        assert rows_of(statements.drop("block")) == rows_of(star.predication(spark, SF).drop("confidence", "sentence_no"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_entity_sets_are_looked_up_in_one_scan(spark):
    tags = spark.createDataFrame([("C", 1, "a", "A"), ("C", 1, "b", "A"), ("C", 2, "a", "A"), ("C", 3, "b", "A"), ("C", 3, "c", "B"), ("D", 3, "a", "A"), ("C", 4, None, "A")], "document_collection string, document_id long, ent_id string, ent_type string")
    query = Query(entity_sets=((Entity("a", "A"), Entity("c", "B")), (Entity("b", "A"),)))
    found = matching.filters(None, query, Vocabulary(), None, tags)
    assert {tuple(r) for r in found.collect()} == {("C", 1), ("C", 3)}
    assert plan(found)[0].count("LogicalRDD") == 1


def test_partitions_grow_with_lines(spark, monkeypatch):
    """No step is dealt into a fixed number of partitions, so that a task's share does not grow with the tables; the rows are the same."""
    named = {"keyword_sample": analytics.QUERIES, "tag_index_delta": indexes.QUERIES, "coverage": analytics.QUERIES}
    expected = {name: rows_of(queries[name](spark, SF)) for name, queries in named.items()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(star, "LINES", -(-star.table(spark, SF, "lineitem").count() // 9))
    try:
        for name, queries in named.items():
            df = queries[name](spark, SF)
            dealt = {int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan(df)[1])}
            assert min(dealt) >= 9, name
            assert rows_of(df) == expected[name]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_merged_lists_are_made_once(spark):
    """A merge makes the lists of either side once, not again for each test of which blocks are new; blocks of one side survive."""
    df = indexes.QUERIES["tag_index_delta"](spark, SF)
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", plan(df)[1])) <= 2
    schema = "document_collection string, ent_id string, document_id long"
    old = indexing.postings(spark.createDataFrame([("C", "a", 1), ("C", "a", 12), ("C", "b", 3)], schema), ["ent_id"], 10)
    merged = indexing.merge_postings(old, spark.createDataFrame([("C", "a", 2), ("C", "a", 1), ("C", "c", 4), ("C", "c", 4), ("D", "a", 1)], schema), ["ent_id"], 10)
    assert merged.columns == old.columns
    assert {tuple(r[:3]): (r.document_ids, r.n) for r in merged.collect()} == {("C", "a", 0): ([2, 1], 2), ("C", "a", 1): ([12], 1), ("C", "b", 0): ([3], 1), ("C", "c", 0): ([4], 1), ("D", "a", 0): ([1], 1)}


def test_concepts_are_sorted_by_document_once(spark):
    """The sort of a document's entities serves both their total and the join with its length; mentions are not sorted."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        physical = plan(analytics.QUERIES["coverage"](spark, SF))[1]
        assert len(re.findall(r"Sort \[document_collection", physical)) == 2  # entities and lengths
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_totals_count_mentions_without_an_entity(spark):
    tags = spark.createDataFrame([("C", 1, "x", "X", 0, 5), ("C", 1, "x", "X", 5, 10), ("C", 1, None, "X", 0, 5), ("C", 2, "x", "X", 0, 5), ("D", 1, "x", "X", 0, 5)], "document_collection string, document_id long, ent_id string, ent_type string, start_pos int, end_pos int")
    docs = tags.select("document_collection", "document_id").distinct()
    found = scoring.concepts(tags, docs.withColumn("text_len", F.lit(20)), scoring.idf(tags, docs))
    assert {(r.document_collection, r.document_id): (r.mentions, r.total, r.coverage) for r in found.collect()} == {("C", 1): (2, 3, 0.5), ("C", 2): (1, 1, 0.25), ("D", 1): (1, 1, 0.25)}
