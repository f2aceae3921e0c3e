"""Readers, writers, and streams that agree with batches."""

import gzip
import json

import pytest

from factloom.operators import indexing, matching
from factloom.sources import published, star, tables
from factloom.streaming import updates

SF = "/root/testdata/sf0.001"


def test_documents(spark, tmp_path):
    doc = {"id": 7, "title": "t", "abstract": "a", "tags": [{"id": "X", "mention": "x", "start": 1, "end": 2, "type": "Drug"}], "statements": [{"subject_id": "X", "subject_type": "Drug", "relation": "treats", "object_id": "Y", "object_type": "Disease", "confidence": 0.5}]}
    (tmp_path / "d.json").write_text(json.dumps([doc, doc | {"id": 8, "statements": []}]))
    docs = tables.read_documents(spark, str(tmp_path / "d.json"), "C", lines=False)
    assert docs.count() == 2
    assert [(r.document_id, r.relation) for r in tables.statements(docs).collect()] == [(7, "treats")]
    t = tables.tags(docs)
    assert {r.document_id for r in t.collect()} == {7, 8}
    back = tables.nested(docs.select("document_collection", "document_id", "title"), t, tables.statements(docs))
    tables.write_documents(back, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    shaped = tables.as_documents(docs.select("document_collection", "document_id", "title"), t, tables.statements(docs))
    tables.write_documents(shaped, str(tmp_path / "lines"))
    again = tables.read_documents(spark, str(tmp_path / "lines"), "C")
    assert sorted(map(tuple, tables.tags(again).collect())) == sorted(map(tuple, t.collect())) and tables.statements(again).count() == 1
    assert [r.document_id for r in tables.by_ids(again, "8;;x", "C").collect()] == [8] and tables.by_ids(again, "", "C").count() == 0


def test_vocabulary_log_trials(spark, tmp_path):
    with gzip.open(tmp_path / "v.tsv.gz", "wt") as f:
        f.write("G1\tGene one\tg1|gene1\nG2\tGene two\t\n")
    v = tables.read_vocabulary(spark, str(tmp_path / "v.tsv.gz"), "Gene")
    assert sorted((r.entity_id, r.synonym) for r in v.collect()) == [("G1", "Gene one"), ("G1", "g1"), ("G1", "gene1"), ("G2", "Gene two")]
    (tmp_path / "log.tsv").write_text("timestamp\tquery_string\n2024.01.05-10:00:00\tABC\nbroken\tx\n")
    assert [(str(r.log_date), r.query_string) for r in tables.read_log(spark, str(tmp_path / "log.tsv"), "query_string string").collect()] == [("2024-01-05", "abc")]
    (tmp_path / "t.csv").write_text("Interventions,Conditions,Phases,Other\na|b,c,PHASE1,z\n")
    assert tuple(tables.read_trials(spark, str(tmp_path / "t.csv")).first()) == ("a|b", "c", "PHASE1")
    log = spark.createDataFrame([("2024.01.05-10:00:00", "Q", "2024-01-05"), ("2024.01.06-10:00:00", "R", "2024-01-06")], "timestamp string, query_string string, log_date string")
    for _ in range(2):
        tables.append_log(log, str(tmp_path / "logs"))
    assert sorted((str(r.log_date), r.query_string) for r in tables.read_log(spark, str(tmp_path / "logs"), "query_string string").collect()) == [("2024-01-05", "q")] * 2 + [("2024-01-06", "r")] * 2
    tables.write_vocabulary(v.select("entity_id", "synonym"), str(tmp_path / "vocabulary"))
    assert sorted(map(tuple, spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "vocabulary")).collect())) == sorted((r.entity_id, r.synonym) for r in v.collect())
    (tmp_path / "sources.json").write_text('[{"name": "A", "shown": true}, {"name": "B"}]')
    assert [(r.name, r.shown) for r in tables.read_settings(spark, str(tmp_path / "sources.json"), "name string, shown boolean").collect()] == [("A", True), ("B", None)]


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        tables.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    tables.replace_table(spark.read.parquet(path).where("id > 1"), path)  # reads what it replaces
    assert spark.read.parquet(path).count() == 3


def test_replace_and_dummy(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "name string, v int")
    b = spark.createDataFrame([("y", 3)], "name string, v int")
    assert sorted(map(tuple, tables.replace_key(a, b, ["name"]).collect())) == [("x", 1), ("y", 3)]
    d = tables.dummy_statements(spark, 20)
    assert d.count() == 200 and sorted(d.collect()) == sorted(tables.dummy_statements(spark, 20).collect())
    assert matching.facts(d).count() > 0
    docs, tags, lines = tables.dummy_documents(spark, 20)
    assert (docs.count(), tags.count(), lines.select("sentence_id").distinct().count()) == (20, 200, 200)
    assert sorted(tags.collect()) == sorted(tables.dummy_documents(spark, 20)[1].collect())


def test_daily_counts_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    events = star.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = updates.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, updates.daily_counts(events).collect()))


def test_index_stream_equals_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(updates, "LAYERS", 2)
    rows, key = indexing.tag_rows(star.tag(spark, SF)), ["ent_id", "ent_type"]
    source, folder = str(tmp_path / "rows"), tmp_path / "index"
    assert updates.current(spark, str(folder), key) is None
    listed = lambda df: sorted(map(tuple, df.select("document_collection", *key, "block", "document_ids", "n").collect()))
    parts = ("document_collection = 'ORD_F'", "document_collection <> 'ORD_F'", "document_collection = 'ORD_O'", "ent_type = 'Brand'", "document_id < 100")
    for part in parts:
        rows.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        updates.keep_index(stream, str(folder), key, str(tmp_path / "ck")).awaitTermination()
    assert listed(updates.current(spark, str(folder), key)) == listed(indexing.postings(rows, key))
    names = sorted(p.name for p in folder.iterdir() if p.name.startswith("v-"))
    assert names[0].endswith("-whole") and len(names) < len(parts)  # older layers went
    (folder / names[-1] / "_SUCCESS").unlink()  # a layer that a crash left incomplete is not read, and is written again with its batch
    assert names[-1] not in updates._layers(spark, str(folder))


@pytest.mark.parametrize("layers", [1, 3])
def test_a_batch_that_runs_again_loses_nothing(spark, tmp_path, monkeypatch, layers):
    """The last commit of the stream is lost after every batch, so each batch runs twice, whether it wrote a whole layer or not."""
    monkeypatch.setattr(updates, "LAYERS", layers)
    key, source, folder, ck = ["term"], str(tmp_path / "rows"), tmp_path / "index", tmp_path / "ck"
    schema = "document_collection string, document_id long, term string"

    def run():
        updates.keep_index(spark.readStream.schema(schema).parquet(source), str(folder), key, str(ck)).awaitTermination()

    for i in range(5):
        spark.createDataFrame([("C", i, f"t{i}"), ("C", i, "all")], schema).write.mode("append").parquet(source)
        run()
        (ck / "commits" / str(i)).unlink()
        for p in (ck / "commits").glob(f".{i}.crc"):
            p.unlink()
        run()
        got = {r.term: sorted(r.document_ids) for r in updates.current(spark, str(folder), key).collect()}
        assert got == {"all": list(range(i + 1))} | {f"t{k}": [k] for k in range(i + 1)}


def test_an_index_belongs_to_one_stream(spark, tmp_path):
    schema = "document_collection string, document_id long, term string"
    spark.createDataFrame([("C", 1, "a")], schema).write.parquet(str(tmp_path / "rows"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "rows"))
    updates.keep_index(stream(), str(tmp_path / "index"), ["term"], str(tmp_path / "one")).awaitTermination()
    with pytest.raises(Exception, match="another stream"):
        updates.keep_index(stream(), str(tmp_path / "index"), ["term"], str(tmp_path / "two")).awaitTermination()
    # the index is gone, but not its stream
    spark.createDataFrame([("C", 2, "b")], schema).write.mode("append").parquet(str(tmp_path / "rows"))
    with pytest.raises(Exception, match="finds no index"):
        updates.keep_index(stream(), str(tmp_path / "elsewhere"), ["term"], str(tmp_path / "one")).awaitTermination()


def test_replace_table_after_a_crash(spark, tmp_path):
    path = tmp_path / "t"
    tables.replace_table(spark.range(3), str(path))
    path.rename(tmp_path / "t.old")  # between the two renames
    with pytest.raises(Exception):
        tables.replace_table(spark.range(1).selectExpr("raise_error('no') AS x"), str(path))
    assert spark.read.parquet(str(path)).count() == 3  # put back, and left by the failed write
    tables.replace_table(spark.range(4), str(path))
    assert spark.read.parquet(str(path)).count() == 4 and not (tmp_path / "t.old").exists()


def _service_tables(spark):
    p, t = star.predication(spark, SF), indexing.tag_rows(star.tag(spark, SF))
    docs = star.document(spark, SF)
    return {"predications": indexing.predication_index(p), "tags": indexing.tag_index(star.tag(spark, SF)), "documents": docs, "terms": indexing.term_index(docs.withColumnRenamed("title", "text")), "mentions": t}


def test_tables_are_published_together(spark, tmp_path):
    folder = str(tmp_path / "service")
    own = _service_tables(spark)
    assert published.read(spark, folder) == {} and published.publish(spark, folder, own) == 1
    first = {n: df.count() for n, df in published.read(spark, folder).items()}
    assert first == {n: df.count() for n, df in own.items()}
    kept = published.read(spark, folder)  # a reader that goes on while a collection is taken out
    assert published.delete_collection(spark, folder, "ORD_P") == 2
    now = published.read(spark, folder)
    assert {n: df.count() for n, df in now.items()} == {n: df.where("document_collection <> 'ORD_P'").count() for n, df in own.items()}
    assert all("ORD_P" not in {r[0] for r in df.select("document_collection").distinct().collect()} for df in now.values())
    assert {n: df.count() for n, df in kept.items()} == first == {n: df.count() for n, df in published.read(spark, folder, 1).items()}
    assert published.publish(spark, folder, {"mentions": own["mentions"]}) == 3  # a collection comes back in one table
    assert published.read(spark, folder)["mentions"].count() == first["mentions"] and published.read(spark, folder)["tags"].count() < first["tags"]
    assert published.clean(spark, folder, keep=1) == 1 and published.versions(spark, folder) == [3]
    assert published.read(spark, folder)["documents"].count() < first["documents"]


@pytest.mark.parametrize("step", range(5))
def test_a_crash_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    """The writer is stopped after that many tables, or before the manifest."""
    folder = str(tmp_path / "service")
    schema = "document_collection string, document_id long"
    old, new = spark.createDataFrame([("A", 1)], schema), spark.createDataFrame([("A", 2), ("B", 3)], schema)
    names = ["p", "q", "r"]
    published.publish(spark, folder, dict.fromkeys(names, old))
    bad = new.selectExpr("document_collection", "CAST(raise_error('stopped') AS BIGINT) AS document_id")
    if step == 3:
        monkeypatch.setattr(published, "_write_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    if step == 4:  # another writer was faster
        real = published._write_manifest
        monkeypatch.setattr(published, "_write_manifest", lambda s, f, v, c: (real(s, f, v, published.manifest(s, f)), real(s, f, v, c)))
    with pytest.raises(Exception, match="stopped|another writer"):
        published.publish(spark, folder, {n: bad if k == step else new for k, n in enumerate(names)})
    assert {n: [tuple(r) for r in df.collect()] for n, df in published.read(spark, folder).items()} == dict.fromkeys(names, [("A", 1)])
    monkeypatch.undo()
    published.publish(spark, folder, dict.fromkeys(names, new))
    assert all(df.count() == 2 for df in published.read(spark, folder).values())
