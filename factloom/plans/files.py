"""Queries that write files in the formats of exchange, or service tables, and read them back. Each run has folders of its own in the shared storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import indexing, matching
from ..sources import published, shared, star, tables

_folder = shared.new


def documents_json(spark, d):
    """Every document with its mentions and statements as JSON, and its statements read back."""
    path = _folder(spark, "documents")
    docs = star.document(spark, d).select("document_collection", "document_id", "title")
    tables.write_documents(tables.as_documents(docs, star.tag(spark, d), star.predication(spark, d)), path)
    return tables.statements(tables.read_documents(spark, path, "read")).select("document_id", "subject_id", "subject_type", "relation", "object_id", "object_type", F.round("confidence", 4).alias("confidence"))


def documents_json_tags(spark, d):
    path = _folder(spark, "documents_tags")
    docs = star.document(spark, d).select("document_collection", "document_id", "title")
    tables.write_documents(tables.as_documents(docs, star.tag(spark, d), star.predication(spark, d)), path)
    return tables.tags(tables.read_documents(spark, path, "read")).select("document_id", "ent_id", "ent_type", "start_pos", "end_pos")


def log_tsv(spark, d):
    """The usage log appended by day and read back."""
    path = _folder(spark, "log")
    log = star.query_log(spark, d).select(F.concat(F.date_format("log_date", "yyyy.MM.dd"), F.lit("-10:00:00")).alias("timestamp"), F.upper("query_string").alias("query_string"), "user_id", "log_date")
    tables.replace_table(log.limit(0), path)  # an empty folder
    tables.append_log(log, path)
    read = tables.read_log(spark, path, "query_string string, user_id long")
    return read.groupBy("log_date", "query_string").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def vocabulary_tsv(spark, d):
    path = _folder(spark, "vocabulary")
    rows = star.table(spark, d, "part").groupBy(F.col("p_brand").alias("entity_id")).agg(F.min("p_type").alias("heading"), F.array_join(F.sort_array(F.collect_set("p_name")), "|").alias("synonyms"))
    tables.write_vocabulary(rows, path)
    return tables.read_vocabulary(spark, path, "Brand", header=True).select("entity_id", "entity_type", "synonym")


def replaced_table(spark, d):
    """A stored index table replaced as a whole, then keys of one collection."""
    path = _folder(spark, "support")
    own = star.document(spark, d).groupBy("document_collection").agg(F.count("*").alias("n"))
    tables.replace_table(own.withColumn("n", F.lit(0).cast("long")), path)
    tables.replace_table(own, path)
    more = own.where("document_collection = 'ORD_P'").withColumn("n", -F.col("n"))
    return tables.replace_key(spark.read.parquet(path), more, ["document_collection"])


def service_without_collection(spark, d):
    """All service tables published together, and a collection taken out of all of them."""
    folder = _folder(spark, "service")
    docs = star.document(spark, d)
    own = {"predications": indexing.predication_index(star.predication(spark, d)), "tags": indexing.tag_index(star.tag(spark, d)), "terms": indexing.term_index(docs.withColumnRenamed("title", "text")), "documents": docs, "metadata": star.metadata(spark, d)}
    published.publish(spark, folder, own)
    published.delete_collection(spark, folder, "ORD_P")
    counts = [df.groupBy("document_collection").agg(F.count("*").alias("n")).select(F.lit(name).alias("service_table"), "document_collection", "n") for name, df in published.read(spark, folder).items()]
    return reduce(DataFrame.unionByName, counts)


QUERIES = {
    "service_without_collection": service_without_collection,
    "documents_json": documents_json,
    "documents_json_tags": documents_json_tags,
    "log_tsv": log_tsv,
    "vocabulary_tsv": vocabulary_tsv,
    "replaced_table": replaced_table,
    "documents_by_ids": lambda s, d: tables.by_ids(star.document(s, d), "7;1;x;32;96", "ORD_O").select("document_id", "title"),
    "statement_entities": lambda s, d: matching.entities(star.predication(s, d)),
}
_BLOCK = indexing.BLOCK
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS)
_POSTED = lambda name, key, rows: f"SELECT '{name}' AS service_table, document_collection, count(*) AS n FROM (SELECT DISTINCT document_collection, {key}, document_id // {_BLOCK} AS block FROM {rows}) WHERE document_collection <> 'ORD_P' GROUP BY 2"
_TITLES = "(SELECT document_collection, document_id, unnest(string_split(lower(title), ' ')) AS term FROM fx_document UNION ALL SELECT document_collection, document_id, unnest(string_split(regexp_replace(lower(title), '[[:punct:]]', ' ', 'g'), ' ')) FROM fx_document)"
_WHOLE = lambda name, rows: f"SELECT '{name}', document_collection, count(*) FROM {rows} WHERE document_collection <> 'ORD_P' GROUP BY 2"
ORACLE = {
    "service_without_collection": star.sql(" UNION ALL ".join([_POSTED("predications", "subject_id, subject_type, relation, object_id, object_type", "facts"), _POSTED("tags", "ent_id, ent_type", "fx_tag"), _POSTED("terms", "term", f"{_TITLES} t WHERE term <> '' AND term NOT IN ({_STOP})"), _WHOLE("documents", "fx_document"), _WHOLE("metadata", "fx_metadata")])),
    "documents_json": star.sql("SELECT document_id, subject_id, subject_type, relation, object_id, object_type, round(CAST(confidence AS DOUBLE), 4) AS confidence FROM fx_predication"),
    "documents_json_tags": star.sql("SELECT document_id, ent_id, ent_type, CAST(start_pos AS INTEGER) AS start_pos, CAST(end_pos AS INTEGER) AS end_pos FROM fx_tag"),
    "log_tsv": star.sql("SELECT log_date, lower(query_string) AS query_string, count(*) AS n, count(DISTINCT user_id) AS users FROM fx_query_log GROUP BY ALL"),
    "vocabulary_tsv": "SELECT p_brand AS entity_id, 'Brand' AS entity_type, min(p_type) AS synonym FROM part GROUP BY 1 UNION SELECT p_brand, 'Brand', p_name FROM part",
    "replaced_table": star.sql("SELECT document_collection, CASE WHEN document_collection = 'ORD_P' THEN -count(*) ELSE count(*) END AS n FROM fx_document GROUP BY 1"),
    "documents_by_ids": star.sql("SELECT document_id, title FROM fx_document WHERE document_id IN (7, 1, 32, 96) AND document_collection = 'ORD_O'"),
    "statement_entities": star.sql("SELECT subject_id AS ent_id, subject_type AS ent_type FROM fx_predication UNION SELECT object_id, object_type FROM fx_predication"),
}
