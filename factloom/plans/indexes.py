"""Queries of index building, filters and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..model import ANY, Entity, Pattern, Query, Var
from ..operators import indexing, matching, results
from ..sources import star
from .patterns import B, N, V, X, _facts, _statements

CUT = "1998-01-01"
BLOCK = 4096  # small blocks, so that lists have several of them here


def _join(df, *columns):
    """Posting lists as text, for comparison."""
    for c in columns:
        df = df.withColumn(c, F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return df


def _old(rows, docs):
    return rows.join(docs.where(F.col("date_inserted") < F.lit(CUT).cast("date")).select(*indexing.DOC), indexing.DOC, "left_semi")


def pred_index(spark, d):
    return _join(indexing.predication_index(star.predication(spark, d), BLOCK), "document_ids")


def pred_support(spark, d):
    return indexing.supports(indexing.predication_index(star.predication(spark, d), BLOCK), indexing.FACT_KEY)


def pred_index_delta(spark, d):
    p, docs = star.predication(spark, d).where("relation IS NOT NULL"), star.document(spark, d)
    old = indexing.predication_index(_old(p, docs), BLOCK)
    return _join(indexing.merge_postings(old, indexing.since(p, docs, CUT), indexing.FACT_KEY, BLOCK), "document_ids")


def pred_index_changed(spark, d):
    """The blocks that a few new documents touch."""
    p, docs = star.predication(spark, d).where("relation IS NOT NULL"), star.document(spark, d)
    old = indexing.predication_index(_old(p, docs), BLOCK)
    return _join(indexing.changed_postings(old, indexing.since(p, docs, "1998-07-01"), indexing.FACT_KEY, BLOCK), "document_ids")


def tag_index(spark, d):
    return _join(indexing.tag_index(star.tag(spark, d), block=BLOCK), "document_ids")


def tag_index_delta(spark, d):
    t, docs = indexing.tag_rows(star.tag(spark, d)), star.document(spark, d)
    old = indexing.postings(_old(t, docs), ["ent_id", "ent_type"], BLOCK)
    return _join(indexing.merge_postings(old, indexing.since(t, docs, CUT), ["ent_id", "ent_type"], BLOCK), "document_ids")


def tag_translated(spark, d):
    names = star.table(spark, d, "nation").select(F.col("n_name").alias("ent_id"), F.concat(F.lit("N:"), "n_nationkey").alias("new_id"))
    return _join(indexing.tag_index(star.tag(spark, d), names, BLOCK), "document_ids")


def term_index(spark, d):
    docs = star.document(spark, d).withColumnRenamed("title", "text")
    return _join(indexing.term_index(docs, BLOCK), "document_ids")


def text_terms(spark, d):
    rows = indexing.term_rows(star.text_document(spark, d)).distinct()
    return rows.groupBy("document_collection", "term").agg(F.count("*").alias("n")).where("n > 1")


def doc_metadata_service(spark, d):
    authors = star.table(spark, d, "lineitem").join(star.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_join(F.sort_array(F.collect_set("s_name")), " | ").alias("authors"))
    meta = star.metadata(spark, d).join(authors, "document_id", "left")
    present = star.document(spark, d).where("document_collection = 'ORD_P'").select(*indexing.DOC)
    return _join(indexing.document_metadata(meta, star.document(spark, d), star.classification(spark, d), present), "classifications").withColumn("classifications", F.coalesce("classifications", F.lit("")))


def _vocabulary(spark, d):
    """Nations and regions as classes, parts as products: a vocabulary with classes and inherited terms."""
    o = star.ontology(spark, d)
    nations = o.select(F.col("descriptor_id").alias("entity_id"), F.lit("Nation").alias("entity_type"), F.lit(None).cast("string").alias("entity_class"), F.col("descriptor_id").alias("synonym"))
    classes = o.select(F.col("descriptor_id").alias("entity_id"), F.lit("Nation").alias("entity_type"), F.col("root_name").alias("entity_class"), F.col("root_name").alias("synonym"))
    parts = star.table(spark, d, "part").select(F.col("p_brand").alias("entity_id"), F.lit("Brand").alias("entity_type"), F.lit(None).cast("string").alias("entity_class"), F.col("p_name").alias("synonym")).distinct()
    return [nations, classes, parts]


def _index(spark, d):
    return indexing.tagger_index(_vocabulary(spark, d))


def _tree_index(spark, d):
    """Regions above nations in the tree: names of regions are inherited by their nations."""
    tree = star.ontology(spark, d).select("descriptor_id", "tree_no").unionByName(star.ontology(spark, d).select(F.col("root_name").alias("descriptor_id"), F.substring_index("tree_no", ".", 1).alias("tree_no")).distinct())
    names = tree.select(F.col("descriptor_id").alias("entity_id"), F.lit("Place").alias("entity_type"), F.lit(None).cast("string").alias("entity_class"), F.col("descriptor_id").alias("synonym")).distinct()
    return indexing.tagger_index([names], tree.distinct())


def present_vocabulary(spark, d):
    names = star.table(spark, d, "part").select(F.col("p_brand").alias("entity_id"), F.concat_ws("|", "p_name", "p_type", "p_name").alias("synonyms"))
    return indexing.present_vocabulary(names, star.tag(spark, d).where("ent_id <> 'Brand#7'"), "Brand").distinct()


def class_terms(spark, d):
    classes = star.table(spark, d, "region").select(F.col("r_regionkey").alias("class_id"), F.col("r_name").alias("class_name"))
    members = star.table(spark, d, "nation").select(F.col("n_regionkey").alias("class_id"), F.col("n_name").alias("entity_id"), F.lit("Nation").alias("entity_type"))
    return indexing.class_members(classes, members)


def _titles(spark, d):
    return star.document(spark, d).select("document_id", "document_collection", "title")


def _filtered(text):
    return lambda s, d: results.by_title(_titles(s, d), text)


def _answer_years(spark, d):
    return matching.match(_statements(spark, d), Query((Pattern(X("S", "Nation"), ANY, B(2)),)), V).join(star.metadata(spark, d), matching.DOC)


def class_filter_all(spark, d):
    grouped = star.classification(spark, d).groupBy("document_id").agg(F.collect_set("classification").alias("classifications"))
    docs = star.text_document(spark, d).select("document_id", "document_collection").join(grouped, "document_id", "left")
    return results.by_classes(docs, ["quality", "toxic"]).select("document_id", "document_collection")


def _classed(spark, d):
    """Answers with years and, as classes, their journals."""
    docs = star.document(spark, d).select(*indexing.DOC, "title")
    return _answer_years(spark, d).join(docs, indexing.DOC).withColumn("classifications", F.array("journals"))


def _view(view, part):
    def run(spark, d):
        rows = view(_classed(spark, d), "building or machinery", ["NATION_3"], 1993, 1996)[part]
        return rows if part else rows.select(*indexing.DOC, "S_id", "publication_year")

    return run


def ontology_sorted(spark, d):
    rows = _answer_years(spark, d).join(star.ontology(spark, d).select(F.col("descriptor_id").alias("S_id"), "root_name"), "S_id")
    ranked = results.sorted_groups(rows.select("root_name", "S_id", "document_id", "publication_year", "publication_month"), ["root_name", "S_id"])
    return ranked.select("root_name", "S_id", "document_id", *[F.col(c).cast("long").alias(c) for c in ("root_name_rank", "S_id_rank", "document_rank")])


def _pair(spark, d):
    return matching.match(_statements(spark, d), Query((Pattern(X("S", "Nation"), "treats", X("O", "Brand")),)), V)


def page_slice(spark, d):
    groups = results.tree_level(_pair(spark, d), ["S"])
    return results.page(groups, 5, 12, [F.desc("n"), "S_id"])


def subst_newest(spark, d):
    rows = _answer_years(spark, d)
    return results.newest_first(rows, ["S_id", "S_type"], 3).select("S_id", "document_id", "publication_year", "publication_month", F.col("rank").cast("long").alias("rank"))


def ontology_misc(spark, d):
    a = matching.match(_statements(spark, d), Query((Pattern(X("S"), ANY, B(2)),)), V)
    return results.outside_ontology(a, "S", star.ontology(spark, d))


def _overview(spark, d):
    return results.overview(_facts(spark, d), "Brand#2", ["Nation", "Segment"])


QUERIES = {
    "pred_index": pred_index,
    "pred_index_delta": pred_index_delta,
    "tag_index": tag_index,
    "tag_index_delta": tag_index_delta,
    "tag_translated": tag_translated,
    "term_index": term_index,
    "text_terms": text_terms,
    "doc_metadata_service": doc_metadata_service,
    "collection_delete": lambda s, d: _join(indexing.without_collection(indexing.tag_index(star.tag(s, d), block=BLOCK), "ORD_F"), "document_ids"),
    "pred_support": pred_support,
    "pred_index_changed": pred_index_changed,
    "tagger_tree_terms": lambda s, d: _tree_index(s, d).select("entity_id", "entity_type", "synonym", "synonym_processed"),
    "present_vocabulary": present_vocabulary,
    "class_terms": class_terms,
    "watermark_replaced": lambda s, d: indexing.watermark(star.document(s, d).where("date_inserted < DATE '1995-01-01'"), s.sql("SELECT DATE '1996-02-03' AS last_update")),
    "entity_delete": lambda s, d: indexing.without_entity(star.predication(s, d), "Brand#2").groupBy("document_collection", "relation").agg(F.count("*").alias("n")),
    "retype_entities": lambda s, d: indexing.retype(star.tag(s, d), ["NATION_1", "NATION_2"], "Country").groupBy("ent_id", "ent_type").agg(F.count("*").alias("n")),
    "update_watermark": lambda s, d: indexing.watermark(star.document(s, d)),
    "ontology_descendants": lambda s, d: indexing.with_descendants(star.ontology(s, d)),
    "tagger_prefix_tokens": lambda s, d: indexing.find_entities(_index(s, d), "rin Sma").select("entity_id", "entity_type", "synonym"),
    "tagger_class_terms": lambda s, d: indexing.find_entities(_index(s, d), "Asi"),
    "known_terms": lambda s, d: _join(indexing.known_terms(_index(s, d)), "entity_types"),
    "explainer_terms": lambda s, d: _join(indexing.explainer_index(_index(s, d).where("entity_class IS NULL").select("entity_id", F.col("synonym").alias("term"))), "entity_terms"),
    "restricted_vocabulary": lambda s, d: indexing.restricted(_index(s, d), star.tag(s, d).where("ent_id <> 'NATION_3'"), "NATION_").select("entity_id", "synonym").distinct(),
    "title_filter_and": _filtered("building 1-urg*"),
    "title_filter_or_paren": _filtered("(building or machinery) and 5-low"),
    "title_filter_phrase": _filtered("specified+build"),
    "title_filter_mixed": _filtered("1-urgent build or not specified auto and 5-low"),
    "title_filter_and_not": _filtered("building and not (1-urgent or 5-low)"),
    "main_view": _view(results.main_view, 0),
    "main_view_histogram": _view(results.main_view, 1),
    "recommendation_view": _view(results.recommendation_view, 0),
    "recommendation_view_histogram": _view(results.recommendation_view, 1),
    "ontology_sorted": ontology_sorted,
    "ontology_roots": lambda s, d: results.ontology_counts(_pair(s, d), "S", star.ontology(s, d), {"Nation": ["R1.", "R3.N"], "Brand": ["R2"]}),
    "year_range": lambda s, d: results.by_year(_answer_years(s, d), 1995, 1997).select("document_id", "document_collection", "S_id", "publication_year"),
    "year_histogram": lambda s, d: results.year_histogram(_answer_years(s, d).where("publication_year <> 1996")),
    "class_filter_all": class_filter_all,
    "subst_tree_l1": lambda s, d: results.tree_level(_pair(s, d), ["S"]),
    "subst_tree_l2": lambda s, d: results.tree_level(_pair(s, d), ["S", "O"]),
    "subst_flat": lambda s, d: results.flat_groups(_pair(s, d), ["S", "O"]),
    "subst_newest": subst_newest,
    "page_slice": page_slice,
    "ontology_counts": lambda s, d: results.ontology_counts(_pair(s, d), "S", star.ontology(s, d)),
    "ontology_misc": ontology_misc,
    "overview_panels": _overview,
    "adverse_minus_indications": lambda s, d: results.minus_indications(results.overview(_facts(s, d), "Brand#2", ["Nation"])),
}

_IDX = f"document_id // {BLOCK} AS block, array_to_string(list_sort(list(DISTINCT document_id), 'DESC'), ',') AS document_ids, count(DISTINCT document_id) AS n"
_FK = "document_collection, subject_id, subject_type, relation, object_id, object_type"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
_PUNCT = T.string.punctuation.replace("'", "''")


def _terms_sql(source: str, text: str) -> str:
    low = f"trim(lower({text}), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    plain = f"trim(translate({low}, '{_PUNCT}', '{' ' * len(T.string.punctuation)}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"SELECT DISTINCT document_collection, document_id, term FROM (SELECT document_collection, document_id, unnest(string_split({low}, ' ') || string_split({plain}, ' ')) AS term FROM {source}) WHERE term <> '' AND term NOT IN ({_STOP})"


_VOC = """SELECT DISTINCT *, ' ' || trim(regexp_replace(regexp_replace(lower(synonym), '[[:punct:]]', ' ', 'g'), ' +', ' ', 'g')) AS synonym_processed FROM (
SELECT descriptor_id AS entity_id, 'Nation' AS entity_type, CAST(NULL AS VARCHAR) AS entity_class, descriptor_id AS synonym FROM fx_ontology
UNION ALL SELECT descriptor_id, 'Nation', root_name, root_name FROM fx_ontology
UNION ALL SELECT DISTINCT p_brand, 'Brand', NULL, p_name FROM part)"""
_YEARS = "SELECT DISTINCT document_collection, document_id, subject_id AS S_id, subject_type AS S_type, publication_year, publication_month FROM facts JOIN fx_metadata USING (document_collection, document_id) WHERE subject_type = 'Nation' AND object_id = 'Brand#2'"
_PAIR = "SELECT * FROM (SELECT DISTINCT document_collection, document_id, subject_id AS S_id, subject_type AS S_type FROM facts WHERE relation = 'treats' AND subject_type = 'Nation') JOIN (SELECT DISTINCT document_collection, document_id, object_id AS O_id, object_type AS O_type FROM facts WHERE relation = 'treats' AND subject_type = 'Nation') USING (document_collection, document_id)"
_VIEW = "SELECT y.* FROM y JOIN fx_document USING (document_collection, document_id) JOIN fx_metadata m USING (document_collection, document_id) WHERE (contains(lower(title), 'building') OR contains(lower(title), 'machinery')) AND journals = 'NATION_3'"
_HIST = "SELECT CAST(g AS INTEGER) AS year, count(publication_year) AS n FROM (SELECT unnest(range((SELECT min(publication_year) FROM w), (SELECT max(publication_year) + 1 FROM w))) AS g) LEFT JOIN w ON g = publication_year GROUP BY g"
_PANEL = "SELECT relation, subject_type AS other_type, subject_id AS other_id, count(DISTINCT (document_collection, document_id)) AS n FROM facts WHERE object_id = 'Brand#2' GROUP BY ALL"
ORACLE = {
    "pred_index": star.sql(f"SELECT {_FK}, {_IDX} FROM fx_predication WHERE relation IS NOT NULL GROUP BY ALL"),
    "pred_index_delta": star.sql(f"SELECT {_FK}, {_IDX} FROM fx_predication WHERE relation IS NOT NULL GROUP BY ALL"),
    "tag_index": star.sql(f"SELECT document_collection, ent_id, ent_type, {_IDX} FROM fx_tag GROUP BY ALL"),
    "tag_index_delta": star.sql(f"SELECT document_collection, ent_id, ent_type, {_IDX} FROM fx_tag GROUP BY ALL"),
    "tag_translated": star.sql(f"SELECT document_collection, 'N:' || n_nationkey AS ent_id, ent_type, {_IDX} FROM fx_tag JOIN nation ON ent_id = n_name GROUP BY ALL"),
    "term_index": star.sql(f"SELECT document_collection, term, {_IDX} FROM terms GROUP BY ALL", terms=_terms_sql("fx_document", "title")),
    "text_terms": star.sql("SELECT document_collection, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(*) > 1", terms=_terms_sql("fx_text_document", "text")),
    "doc_metadata_service": star.sql("""SELECT m.document_id, m.document_collection, journals, publication_year, publication_month, title,
  CASE WHEN len(a) > 5 THEN array_to_string(a[1:5], ' | ') || ' | ' || (len(a) - 5) || '+' ELSE coalesce(array_to_string(a, ' | '), '') END AS authors, coalesce(classifications, '') AS classifications
FROM fx_metadata m JOIN fx_document d ON m.document_id = d.document_id AND m.document_collection = d.document_collection
LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT s_name)) AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) x ON m.document_id = l_orderkey
LEFT JOIN (SELECT document_id, array_to_string(list_sort(list(DISTINCT classification)), ',') AS classifications FROM fx_classification GROUP BY 1) c ON m.document_id = c.document_id
WHERE m.document_collection <> 'ORD_P' AND publication_year IS NOT NULL AND publication_year <> 0"""),
    "pred_support": star.sql(f"SELECT {_FK}, count(DISTINCT document_id) AS support FROM fx_predication WHERE relation IS NOT NULL GROUP BY ALL"),
    "pred_index_changed": star.sql(f"SELECT {_FK}, {_IDX} FROM fx_predication WHERE relation IS NOT NULL AND (document_id < 0 OR (document_collection, subject_id, relation, object_id, document_id // {BLOCK}) IN (SELECT (p.document_collection, subject_id, relation, object_id, p.document_id // {BLOCK}) FROM fx_predication p JOIN fx_document d ON p.document_id = d.document_id WHERE relation IS NOT NULL AND date_inserted >= DATE '1998-07-01')) AND document_id IN (SELECT document_id FROM fx_document WHERE date_inserted < DATE '{CUT}' OR date_inserted >= DATE '1998-07-01') GROUP BY ALL"),
    "tagger_tree_terms": star.sql("SELECT DISTINCT entity_id, 'Place' AS entity_type, synonym, ' ' || trim(regexp_replace(regexp_replace(lower(synonym), '[[:punct:]]', ' ', 'g'), ' +', ' ', 'g')) AS synonym_processed FROM (SELECT descriptor_id AS entity_id, descriptor_id AS synonym FROM fx_ontology UNION SELECT root_name, root_name FROM fx_ontology UNION SELECT descriptor_id, root_name FROM fx_ontology)"),
    "present_vocabulary": star.sql("SELECT DISTINCT p_brand AS entity_id, unnest([p_name, p_type]) AS synonym FROM part WHERE p_brand IN (SELECT ent_id FROM fx_tag WHERE ent_id <> 'Brand#7')"),
    "class_terms": "SELECT n_name AS entity_id, 'Nation' AS entity_type, r_name AS entity_class, r_name AS synonym FROM nation JOIN region ON n_regionkey = r_regionkey",
    "watermark_replaced": star.sql("SELECT greatest(max(date_inserted), DATE '1996-02-03') AS last_update FROM fx_document WHERE date_inserted < DATE '1995-01-01'"),
    "collection_delete": star.sql(f"SELECT document_collection, ent_id, ent_type, {_IDX} FROM fx_tag WHERE document_collection <> 'ORD_F' GROUP BY ALL"),
    "entity_delete": star.sql("SELECT document_collection, relation, count(*) AS n FROM fx_predication WHERE subject_id <> 'Brand#2' AND object_id <> 'Brand#2' GROUP BY ALL"),
    "retype_entities": star.sql("SELECT ent_id, CASE WHEN ent_id IN ('NATION_1', 'NATION_2') THEN 'Country' ELSE ent_type END AS ent_type, count(*) AS n FROM fx_tag GROUP BY ALL"),
    "update_watermark": star.sql("SELECT max(date_inserted) AS last_update FROM fx_document"),
    "ontology_descendants": star.sql("SELECT DISTINCT a.descriptor_id AS ancestor, b.descriptor_id AS descriptor_id FROM fx_ontology a JOIN fx_ontology b ON b.tree_no = a.tree_no OR starts_with(b.tree_no, a.tree_no || '.')"),
    "tagger_prefix_tokens": star.sql("SELECT DISTINCT entity_id, entity_type, synonym FROM voc WHERE contains(synonym_processed, ' rin') AND contains(synonym_processed, ' sma')", voc=_VOC),
    "tagger_class_terms": star.sql("SELECT DISTINCT entity_id, entity_type, synonym FROM voc WHERE contains(synonym_processed, ' asi')", voc=_VOC),
    "known_terms": star.sql("SELECT synonym, array_to_string(list_sort(list(DISTINCT entity_type)), ',') AS entity_types FROM voc GROUP BY 1", voc=_VOC),
    "explainer_terms": star.sql("SELECT entity_id, array_to_string(list_sort(list(DISTINCT trim(synonym))), ',') AS entity_terms FROM voc WHERE entity_class IS NULL GROUP BY 1", voc=_VOC),
    "restricted_vocabulary": star.sql("SELECT DISTINCT entity_id, synonym FROM voc WHERE entity_id LIKE 'NATION\\_%' ESCAPE '\\' AND entity_id IN (SELECT ent_id FROM fx_tag WHERE ent_id <> 'NATION_3')", voc=_VOC),
    "title_filter_and": star.sql("SELECT document_id, document_collection, title FROM fx_document WHERE contains(lower(title), 'building') AND contains(lower(title), '1-urg')"),
    "title_filter_or_paren": star.sql("SELECT document_id, document_collection, title FROM fx_document WHERE (contains(lower(title), 'building') OR contains(lower(title), 'machinery')) AND contains(lower(title), '5-low')"),
    "title_filter_phrase": star.sql("SELECT document_id, document_collection, title FROM fx_document WHERE contains(lower(title), 'specified build')"),
    "title_filter_mixed": star.sql("SELECT document_id, document_collection, title FROM fx_document WHERE contains(lower(title), '1-urgent build') OR (contains(lower(title), 'not specified auto') AND contains(lower(title), '5-low'))"),
    "title_filter_and_not": star.sql("SELECT document_id, document_collection, title FROM fx_document WHERE contains(lower(title), 'building') AND NOT (contains(lower(title), '1-urgent') OR contains(lower(title), '5-low'))"),
    "main_view": star.sql("SELECT document_collection, document_id, S_id, publication_year FROM w WHERE publication_year BETWEEN 1993 AND 1996", y=_YEARS, w=_VIEW),
    "main_view_histogram": star.sql(_HIST, y=_YEARS, w=_VIEW),
    "recommendation_view": star.sql("SELECT document_collection, document_id, S_id, publication_year FROM w WHERE publication_year BETWEEN 1993 AND 1996", y=_YEARS, w=_VIEW),
    "recommendation_view_histogram": star.sql(_HIST, y=_YEARS, w="SELECT * FROM y"),
    "ontology_sorted": star.sql("SELECT root_name, S_id, document_id, dense_rank() OVER (ORDER BY r DESC, root_name) AS root_name_rank, dense_rank() OVER (PARTITION BY root_name ORDER BY s DESC, S_id) AS S_id_rank, row_number() OVER (PARTITION BY root_name, S_id ORDER BY publication_year DESC, publication_month DESC, document_id DESC) AS document_rank FROM (SELECT *, count(*) OVER (PARTITION BY root_name) AS r, count(*) OVER (PARTITION BY root_name, S_id) AS s FROM y JOIN fx_ontology ON S_id = descriptor_id)", y=_YEARS),
    "ontology_roots": star.sql("SELECT node, count(*) AS n, CASE WHEN contains(node, '.') THEN regexp_replace(node, '\\.[^.]*$', '') END AS parent FROM (SELECT unnest([split_part(tree_no, '.', 1), tree_no]) AS node FROM p JOIN fx_ontology ON S_id = descriptor_id WHERE S_type = 'Nation' AND (starts_with(tree_no, 'R1.') OR starts_with(tree_no, 'R3.N'))) GROUP BY node", p=_PAIR),
    "year_range": star.sql("SELECT document_id, document_collection, S_id, publication_year FROM y WHERE publication_year BETWEEN 1995 AND 1997", y=_YEARS),
    "year_histogram": star.sql("SELECT CAST(g AS INTEGER) AS year, count(publication_year) AS n FROM (SELECT unnest(range((SELECT min(publication_year) FROM y WHERE publication_year <> 1996), (SELECT max(publication_year) + 1 FROM y WHERE publication_year <> 1996))) AS g) LEFT JOIN (SELECT * FROM y WHERE publication_year <> 1996) ON g = publication_year GROUP BY g", y=_YEARS),
    "class_filter_all": star.sql("SELECT document_id, document_collection FROM fx_text_document WHERE document_id IN (SELECT document_id FROM fx_classification GROUP BY 1 HAVING count(DISTINCT classification) = 2)"),
    "subst_tree_l1": star.sql("SELECT S_id, S_type, count(*) AS n, count(DISTINCT (document_collection, document_id)) AS n_documents FROM p GROUP BY ALL", p=_PAIR),
    "subst_tree_l2": star.sql("SELECT S_id, S_type, O_id, O_type, count(*) AS n, count(DISTINCT (document_collection, document_id)) AS n_documents FROM p GROUP BY ALL", p=_PAIR),
    "subst_flat": star.sql("SELECT array_to_string(list_sort(list_distinct([S_type || ':' || S_id, O_type || ':' || O_id])), ';') AS entities, count(*) AS n FROM p GROUP BY ALL", p=_PAIR),
    "subst_newest": star.sql("SELECT S_id, document_id, publication_year, publication_month, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY S_id, S_type ORDER BY publication_year DESC, publication_month DESC, document_id DESC) AS r FROM y) WHERE r <= 3", y=_YEARS),
    "page_slice": star.sql("SELECT S_id, S_type, count(*) AS n, count(DISTINCT (document_collection, document_id)) AS n_documents FROM p GROUP BY ALL ORDER BY n DESC, S_id LIMIT 7 OFFSET 5", p=_PAIR),
    "ontology_counts": star.sql("SELECT node, count(*) AS n, CASE WHEN contains(node, '.') THEN regexp_replace(node, '\\.[^.]*$', '') END AS parent FROM (SELECT unnest([split_part(tree_no, '.', 1), tree_no]) AS node FROM p JOIN fx_ontology ON S_id = descriptor_id) GROUP BY node", p=_PAIR),
    "ontology_misc": star.sql("SELECT subject_type || ' (no taxonomy)' AS label, subject_id AS S_id, count(DISTINCT (document_collection, document_id)) AS n FROM facts WHERE object_id = 'Brand#2' AND subject_id NOT IN (SELECT descriptor_id FROM fx_ontology) GROUP BY ALL"),
    "overview_panels": star.sql("SELECT * FROM q", q=_PANEL),
    "adverse_minus_indications": star.sql("SELECT a.other_id, a.n FROM (SELECT * FROM q WHERE relation = 'induces' AND other_type = 'Nation') a LEFT JOIN (SELECT * FROM q WHERE relation = 'treats' AND other_type = 'Nation') b ON a.other_id = b.other_id WHERE b.n IS NULL OR b.n < a.n", q=_PANEL),
}
