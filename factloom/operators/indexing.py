"""Inverted indexes over statements, mentions and terms, and the tables that serve metadata, vocabulary and explanations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FACT_KEY = ["subject_id", "subject_type", "relation", "object_id", "object_type"]
DOC = ["document_collection", "document_id"]


#: Document ids of one range of this many make one row of a posting list.
BLOCK = 1 << 20


def postings(rows: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """Posting lists in blocks: for each key, collection and range of ids (block) the distinct documents, highest id first, and their number n.

    A list never has to fit one row or one task, however frequent its key is. supports() gives the number of documents of whole keys.
    """
    docs = F.sort_array(F.collect_set("document_id"), asc=False)
    blocks = rows.groupBy("document_collection", *key, F.floor(F.col("document_id") / block).alias("block")).agg(docs.alias("document_ids"))
    return blocks.withColumn("n", F.size("document_ids").cast("long"))


def supports(index: DataFrame, key: list[str]) -> DataFrame:
    """Documents of each key and collection."""
    return index.groupBy("document_collection", *key).agg(F.sum("n").alias("support"))


def predication_index(predications: DataFrame, block: int = BLOCK) -> DataFrame:
    return postings(predications.where(F.col("relation").isNotNull()), FACT_KEY, block)


def changed_postings(old: DataFrame, new: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """The blocks that new rows touch, old and new documents together. Only blocks with new documents are looked up in the old index."""
    at = ["document_collection", *key, "block"]
    fresh = postings(new, key, block)
    known = old.join(fresh.select(*at), at, "left_semi").select(*at, F.col("document_ids").alias("__old"))
    both = fresh.join(known, at, "left")
    docs = F.sort_array(F.array_union("document_ids", F.coalesce("__old", F.array().cast("array<bigint>"))), asc=False)
    return both.select(*at, docs.alias("document_ids")).withColumn("n", F.size("document_ids").cast("long"))


def merge_postings(old: DataFrame, new: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """An index with the postings of new documents added; blocks without new documents are taken over as they are, and keys of either side survive.

    Blocks of both sides meet in one join, so that each side is read and its lists are made once.
    """
    at = ["document_collection", *key, "block"]
    both = old.select(*at, F.col("document_ids").alias("__old")).join(postings(new, key, block).select(*at, F.col("document_ids").alias("__new")), at, "full")
    docs = F.when(F.col("__new").isNull(), F.col("__old")).when(F.col("__old").isNull(), F.col("__new")).otherwise(F.sort_array(F.array_union("__new", "__old"), asc=False))
    return both.select(*at, docs.alias("document_ids")).withColumn("n", F.size("document_ids").cast("long"))


def since(rows: DataFrame, documents: DataFrame, date: str) -> DataFrame:
    """Rows of documents inserted on or after a date."""
    return rows.join(documents.where(F.col("date_inserted") >= F.lit(date).cast("date")).select(*DOC).distinct(), DOC, "left_semi")


def tag_rows(tags: DataFrame, translation: DataFrame | None = None) -> DataFrame:
    """Distinct mentions of entities in documents, ids translated where a translation (ent_id, new_id) is given; untranslatable ones go."""
    rows = tags.select(*DOC, "ent_id", "ent_type").distinct()
    if translation is not None:
        rows = rows.join(translation, "ent_id").select(*DOC, F.col("new_id").alias("ent_id"), "ent_type").distinct()
    return rows


def tag_index(tags: DataFrame, translation: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    return postings(tag_rows(tags, translation), ["ent_id", "ent_type"], block)


def term_rows(documents: DataFrame) -> DataFrame:
    """(document_collection, document_id, term)."""
    return documents.select(*DOC, F.explode(T.terms(F.col("text"))).alias("term"))


def term_index(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    return postings(term_rows(documents), ["term"], block)


def document_metadata(metadata: DataFrame, documents: DataFrame, classes: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Metadata for the service: documents not yet present, with title, a year, at most five authors, and their classes in order."""
    own = metadata if present is None else metadata.join(present, DOC, "left_anti")
    grouped = classes.groupBy("document_id").agg(F.sort_array(F.collect_set("classification")).alias("classifications"))
    rows = own.where("publication_year IS NOT NULL AND publication_year <> 0").join(documents.select(*DOC, "title"), DOC).join(grouped, "document_id", "left")
    return rows.withColumn("authors", T.first_authors(F.coalesce("authors", F.lit(""))))


def without_collection(rows: DataFrame, collection: str) -> DataFrame:
    return rows.where(F.col("document_collection") != collection)


def without_entity(predications: DataFrame, entity: str) -> DataFrame:
    return predications.where((F.col("subject_id") != entity) & (F.col("object_id") != entity))


def retype(tags: DataFrame, ids: list[str], new_type: str) -> DataFrame:
    return tags.withColumn("ent_type", F.when(F.col("ent_id").isin(ids), new_type).otherwise(F.col("ent_type")))


def with_descendants(ontology: DataFrame) -> DataFrame:
    """(ancestor, descriptor_id): descriptors under a tree number, itself included. Every tree number is joined by its own dotted prefixes."""
    parts = F.split("tree_no", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    below = ontology.select("descriptor_id", F.explode(prefixes).alias("prefix"))
    above = ontology.select(F.col("tree_no").alias("prefix"), F.col("descriptor_id").alias("ancestor"))
    return below.join(above, "prefix").select("ancestor", "descriptor_id").distinct()


def inherited(vocabulary: DataFrame, ontology: DataFrame) -> DataFrame:
    """A vocabulary with every term also given to the descriptors below its own in the tree, with its own type."""
    below = with_descendants(ontology).where("ancestor <> descriptor_id")
    more = vocabulary.join(below.withColumnRenamed("ancestor", "entity_id"), "entity_id").select(F.col("descriptor_id").alias("entity_id"), "entity_type", "entity_class", "synonym")
    return vocabulary.select("entity_id", "entity_type", "entity_class", "synonym").unionByName(more).distinct()


def class_members(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(class_id, class_name) and (class_id, entity_id, entity_type): class names as terms of their members."""
    return classes.join(members, "class_id").select("entity_id", "entity_type", F.col("class_name").alias("entity_class"), F.col("class_name").alias("synonym"))


def tagger_index(vocabularies: list[DataFrame], ontology: DataFrame | None = None) -> DataFrame:
    """Vocabularies (entity_id, entity_type, entity_class, synonym) as one, synonyms also lower-cased with spaces for punctuation and one in front.

    With an ontology, the terms of a descriptor are inherited by all descriptors below it.
    """
    union = reduce(DataFrame.unionByName, vocabularies)
    if ontology is not None:
        union = inherited(union, ontology)
    plain = F.regexp_replace(F.regexp_replace(F.lower("synonym"), r"\p{Punct}", " "), r" +", " ")
    return union.withColumn("synonym_processed", F.concat(F.lit(" "), F.btrim(plain))).distinct()


def present_vocabulary(vocabulary: DataFrame, tags: DataFrame, entity_type: str) -> DataFrame:
    """Rows (entity_id, synonyms joined by bars) of entities of a type that are mentioned somewhere, one for each synonym."""
    used = tags.where(F.col("ent_type") == entity_type).select(F.col("ent_id").alias("entity_id")).distinct()
    return vocabulary.join(used, "entity_id", "left_semi").select("entity_id", F.explode(F.array_distinct(F.split("synonyms", r"\|"))).alias("synonym")).where("synonym <> ''")


def watermark(documents: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(last_update): the newest insertion date of documents and of the stored watermark, which it replaces."""
    dates = documents.select(F.col("date_inserted").cast("date").alias("last_update"))
    return (dates if stored is None else dates.unionByName(stored.select("last_update"))).agg(F.max("last_update").alias("last_update"))


def find_entities(index: DataFrame, term: str) -> DataFrame:
    """Entities with a synonym that has, for every word of the term, a word that begins with it, in any order."""
    tests = [F.contains("synonym_processed", F.lit(f" {w}")) for w in T.search_words(term)]
    return index.where(reduce(Column.__and__, tests)).select("entity_id", "entity_type", "synonym").distinct()


def known_terms(index: DataFrame) -> DataFrame:
    return index.groupBy("synonym").agg(F.sort_array(F.collect_set("entity_type")).alias("entity_types"))


def explainer_index(terms: DataFrame) -> DataFrame:
    """(entity_id, entity_terms) of (entity_id, term)."""
    return terms.groupBy("entity_id").agg(F.sort_array(F.collect_set(F.btrim("term"))).alias("entity_terms"))


def restricted(vocabulary: DataFrame, tags: DataFrame, prefix: str) -> DataFrame:
    """Vocabulary rows whose id begins with a prefix and is mentioned somewhere."""
    used = tags.where(F.startswith("ent_id", F.lit(prefix))).select(F.col("ent_id").alias("entity_id")).distinct()
    return vocabulary.join(used, "entity_id", "left_semi")
