"""Readers and writers of documents, vocabularies, logs and trials, and replacement of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = """id long, title string, abstract string, classification map<string,string>,
tags array<struct<id:string,mention:string,start:int,end:int,type:string>>,
metadata struct<publication_year:int,publication_month:int,authors:string,journals:string,doi:string>,
sections array<struct<position:int,title:string,text:string>>,
sentences array<struct<id:long,text:string>>,
statements array<struct<subject_id:string,subject_str:string,subject_type:string,predicate:string,relation:string,object_id:string,object_str:string,object_type:string,confidence:double,sentence_id:long>>"""


def read_documents(spark: SparkSession, path: str, collection: str, lines: bool = True) -> DataFrame:
    """Documents as JSON, one to a line (files can then be split), or in arrays, a file each; broken ones are dropped."""
    return spark.read.schema(DOCUMENT).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path).withColumn("document_collection", F.lit(collection)).withColumnRenamed("id", "document_id")


def as_documents(documents: DataFrame, tag_rows: DataFrame, statement_rows: DataFrame) -> DataFrame:
    """Documents in the form in which they are exchanged, with their mentions and statements nested, in a fixed order. One document's rows are grouped."""
    key = ["document_collection", "document_id"]
    t = tag_rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("ent_id").alias("id"), F.col("start_pos").cast("int").alias("start"), F.col("end_pos").cast("int").alias("end"), F.col("ent_type").alias("type")))).alias("tags"))
    s = statement_rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("subject_id", "subject_type", "relation", "object_id", "object_type", "confidence"))).alias("statements"))
    return documents.join(t, key, "left").join(s, key, "left").withColumnRenamed("document_id", "id")


def statements(documents: DataFrame) -> DataFrame:
    """Statements of nested documents as rows."""
    return documents.select("document_collection", "document_id", F.explode("statements").alias("s")).select("document_collection", "document_id", "s.*")


def tags(documents: DataFrame) -> DataFrame:
    t = documents.select("document_collection", "document_id", F.explode("tags").alias("t"))
    return t.select("document_collection", "document_id", F.col("t.id").alias("ent_id"), F.col("t.type").alias("ent_type"), F.col("t.start").alias("start_pos"), F.col("t.end").alias("end_pos"))


def nested(documents: DataFrame, tag_rows: DataFrame, statement_rows: DataFrame) -> DataFrame:
    """Documents with their mentions and statements nested, in a fixed order."""
    key = ["document_collection", "document_id"]
    t = tag_rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "ent_id", "ent_type"))).alias("tags"))
    s = statement_rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("subject_id", "relation", "object_id"))).alias("statements"))
    return documents.join(t, key, "left").join(s, key, "left")


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as JSON, one to a line, compressed; readers see that by the files' names. A file holds the documents of one task."""
    documents.write.mode("overwrite").option("compression", "gzip").json(path)


def read_vocabulary(spark: SparkSession, path: str, entity_type: str, header: bool = False) -> DataFrame:
    """Tab-separated id, heading and synonyms (values separated by bars), plain or gzip: one row for each name."""
    rows = spark.read.schema("entity_id string, heading string, synonyms string").option("sep", "\t").option("header", header).csv(path)
    names = F.explode(F.array_union(F.array("heading"), F.split(F.coalesce("synonyms", F.lit("")), r"\|"))).alias("synonym")
    return rows.select("entity_id", F.lit(entity_type).alias("entity_type"), F.lit(None).cast("string").alias("entity_class"), names).where("synonym <> ''")


def write_vocabulary(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Usage logs: tab-separated with a header, values lower-cased, the day taken from ``timestamp``; broken lines are dropped."""
    rows = spark.read.schema(f"timestamp string, {columns}").option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").csv(path).drop("log_date")  # the folders' days
    lowered = [F.lower(c).alias(c) if t == "string" and c != "timestamp" else F.col(c) for c, t in rows.dtypes]
    day = F.expr("try_to_date(substring(timestamp, 1, 10), 'yyyy.MM.dd')").alias("log_date")
    return rows.select(day, *lowered).where("log_date IS NOT NULL")


def append_log(rows: DataFrame, path: str) -> None:
    """Log rows by day."""
    rows.write.mode("append").partitionBy("log_date").option("sep", "\t").option("header", True).csv(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.col(c).alias(c.lower()) for c in ("Interventions", "Conditions", "Phases")])


def replace_key(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with those of the same key replaced."""
    return stored.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def dummy_statements(spark: SparkSession, documents: int, entities: int = 1000, relations: int = 10, per_document: int = 10, seed: int = 1) -> DataFrame:
    """Random statements, the same for the same arguments."""
    rows = spark.range(documents).select(F.col("id").alias("document_id"), F.explode(F.sequence(F.lit(1), F.lit(per_document))).alias("n"))
    pick = lambda what, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "document_id", "n"), F.lit(n)).cast("string")
    return rows.select("document_id", F.lit("DUMMY").alias("document_collection"), F.concat(F.lit("E"), pick("s", entities)).alias("subject_id"), F.lit("A").alias("subject_type"), F.concat(F.lit("R"), pick("r", relations)).alias("relation"), F.concat(F.lit("E"), pick("o", entities)).alias("object_id"), F.lit("B").alias("object_type"))


def replace_table(rows: DataFrame, path: str) -> None:
    """Replace a stored table as a whole: written beside it, then put in its place by two renames. A failed write leaves the old table, a failed rename puts it back.

    Between the renames the table is missing for a moment; tables that are read all the time, or together with others, are better published (published.py).
    """
    spark = rows.sparkSession
    place = lambda end: spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end)
    fs = place("").getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place("")) and fs.exists(place(".old")) and not fs.rename(place(".old"), place("")):  # a crash between the renames
        raise RuntimeError(f"the table in {path} could not be restored from {path}.old")
    rows.write.mode("overwrite").parquet(path.rstrip("/") + ".new")
    fs.delete(place(".old"), True)
    there = fs.exists(place(""))
    if there and not fs.rename(place(""), place(".old")):
        raise RuntimeError(f"the table in {path} could not be set aside and is as it was")
    if not fs.rename(place(".new"), place("")):
        if there and not fs.rename(place(".old"), place("")):
            raise RuntimeError(f"the table in {path} could not be replaced; it is in {path}.old")
        raise RuntimeError(f"the table in {path} could not be replaced and is as it was")
    fs.delete(place(".old"), True)


def read_settings(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A small configuration table (data sources, classifications) from JSON."""
    return spark.read.schema(columns).option("multiLine", True).json(path)


def sentences(documents: DataFrame) -> DataFrame:
    """Sentences of nested documents as rows."""
    return documents.select("document_collection", "document_id", F.explode("sentences").alias("s")).select("document_collection", "document_id", F.col("s.id").alias("sentence_id"), "s.text")


def by_ids(documents: DataFrame, ids: str, collection: str) -> DataFrame:
    """Documents of a collection by a list of ids, separated by semicolons; what is no number is not found."""
    wanted = [int(x) for x in ids.split(";") if x.strip().isdigit()]
    return documents.where((F.col("document_collection") == collection) & F.col("document_id").isin(wanted)) if wanted else documents.where("false")


def dummy_documents(spark: SparkSession, documents: int, entities: int = 1000, per_document: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Random (documents, tags, sentences), the same for the same arguments; a tag and a sentence for each of dummy_statements."""
    rows = spark.range(documents).select(F.lit("DUMMY").alias("document_collection"), F.col("id").alias("document_id"))
    each = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(per_document))))
    pick = lambda what, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "document_id", "n"), F.lit(n))
    start = pick("p", 1000).cast("int")
    tagged = each.select("document_collection", "document_id", F.concat(F.lit("E"), pick("s", entities).cast("string")).alias("ent_id"), F.lit("A").alias("ent_type"), start.alias("start_pos"), (start + 5).alias("end_pos"))
    lines = each.select("document_collection", "document_id", (F.col("document_id") * per_document + F.col("n")).alias("sentence_id"), F.concat_ws(" ", F.lit("Sentence"), "n", F.lit("of document"), "document_id").alias("text"))
    return rows.withColumn("title", F.concat_ws(" ", F.lit("Document"), "document_id")), tagged, lines
