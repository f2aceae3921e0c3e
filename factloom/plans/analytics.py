"""Queries of provenance, scoring, recommendation, schema graph, statistics and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rounded
from ..model import ANY, Pattern, Query
from ..operators import matching, provenance, results, scoring, statistics, suggest, topk
from ..sources import shared, star
from .indexes import _index
from .keywords import porter_sql
from .patterns import B, N, V, _facts, _statements

AS_OF = "2024-01-20"
DOC = scoring.DOC


def _r(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _lengths(spark, d):
    return star.document(spark, d).select(*DOC, (F.length("title") * 5).alias("text_len"))


def _concepts(spark, d):
    tags = star.tag(spark, d)
    return scoring.concepts(tags, _lengths(spark, d), scoring.idf(tags, star.document(spark, d)))


def _edges(spark, d):
    return scoring.edges(star.predication(spark, d), _concepts(spark, d))


PROBE = Query((Pattern(N(1, 2, 3), ANY, B(2)), Pattern(B(3, 4), "interacts", N(5, 6))))


def explain_document(spark, d):
    found = matching.match(_statements(spark, d), Query((Pattern(N(1, 2, 3), ANY, B(2)),)), V)
    rows = provenance.explain(star.predication(spark, d), PROBE, V, found)
    return rows.select("document_id", "pattern", "subject_id", "relation", "object_id", "sentence_no", F.round("confidence", 2).alias("confidence"))


def explanations_shown(spark, d):
    """By pattern, highest confidence first, as the page shows them."""
    rows = provenance.explain(star.predication(spark, d), PROBE, V).where("relation IS NOT NULL").withColumn("confidence", F.col("confidence").cast("double") / 8)
    return provenance.shown(rows).select("document_id", "pattern", "subject_id", "relation", "object_id", "sentence_no", "confidence")


def explain_merged(spark, d):
    rows = provenance.explain(star.predication(spark, d), PROBE, V).where("relation IS NOT NULL")
    return _r(provenance.merged(rows, ["document_id", "pattern", "sentence_no"]), "confidence")


def provenance_sentences(spark, d):
    p = star.predication(spark, d).select("document_id", "subject_id", "object_id", "relation", "sentence_no").where("relation = 'treats' AND object_id = 'Brand#2'").distinct()
    p = p.withColumn("predication_id", F.concat_ws("/", "document_id", "subject_id", "object_id", "sentence_no")).withColumn("sentence_id", F.col("document_id"))
    sentences = star.table(spark, d, "documents").select(F.col("doc_id").alias("sentence_id"), "text")
    ids = p.where("subject_id = 'NATION_3' OR subject_id = 'NATION_4'").select(F.lit(0).alias("pattern"), "predication_id")
    return provenance.by_ids(ids, p, sentences).select("pattern", "predication_id", "subject_id", "relation", "object_id", "sentence")


def _given(spark, d):
    """Profiles of the documents that recommendations are made for (every one whose id is divisible by 100), profiles of all, and idfs. Profiles are derived from the star
    schema once a session, as an application has them in a table."""
    def write(path):
        scoring.profiles(star.tag(spark, d)).join(_lengths(spark, d), DOC, "left").write.parquet(path)
        shared.forget(spark)

    profiles = shared.once(spark, "profiles", d, write, spark.read.parquet)
    idfs = topk.cut(scoring.idf(profiles.select(*DOC, F.inline("ents")), star.document(spark, d), grouped=True))
    return profiles.where("document_id % 100 = 0 AND text_len IS NOT NULL"), profiles, idfs


def _first(spark, d):
    asked, profiles, idfs = _given(spark, d)
    return topk.best(scoring.query_cores(asked, idfs), scoring.entities_of(profiles), scoring.HARD_CUTOFF + 1, scoring.QUERY)[:2]


def first_stage(spark, d):
    """The best documents of each query, as many as the cut-off looks at."""
    return _first(spark, d)[0]


def dynamic_cutoff(spark, d):
    ranked, low = _first(spark, d)
    return scoring.dynamic_cutoff(ranked, per=scoring.QUERY, low=low).select(*scoring.QUERY, *DOC, "score", F.col("rank").cast("long").alias("rank"))


def _cores(spark, d, digits=None):
    """Statement cores of the queries, candidates, and statement cores of both."""
    asked, profiles, idfs = _given(spark, d)
    first = topk.written(scoring.candidates(asked, profiles, idfs), "candidates")
    own, cores = scoring.second_stage(asked, first, profiles, idfs, star.predication(spark, d), digits)
    return own, first.select(*scoring.QUERY, *DOC), cores


def core_overlap(spark, d):
    return _r(scoring.core_overlap(*_cores(spark, d)), "score")


def explanation_graph(spark, d):
    return scoring.explanation_graph(*_cores(spark, d, 9)).select(*scoring.QUERY, *DOC, "a", "b", "both", "a_shared", "b_shared")


def recommendations(spark, d):
    """Both stages for every document whose id is divisible by 100."""
    found = scoring.recommend(*_given(spark, d), star.predication(spark, d))
    return _r(found.withColumn("rank", F.col("rank").cast("long")), "score")


def document_graph_top(spark, d):
    graph = scoring.document_graph(_edges(spark, d)).withColumn("score", F.round("score", 9))
    return scoring.top_facts(graph, 3)


def confidence_rounded(spark, d):
    x = star.table(spark, d, "lineitem").select((F.col("l_quantity").cast("double") / 400).alias("x"), (F.col("l_linenumber") + F.col("l_quantity").cast("double") / 1000).alias("y")).distinct()
    return x.select(F.round("x", 6).alias("x"), rounded(F.col("x")).alias("x2"), F.round("y", 6).alias("y"), rounded(F.col("y")).alias("y2"))


def keyword_sample(spark, d):
    return statistics.sampled_documents(star.tag(spark, d), 20, 7)


def _scored(spark, d):
    """Words of product names, by brand, rarer ones with a lower score."""
    words = star.table(spark, d, "part").select(F.col("p_brand").alias("entity_id"), F.explode(F.split("p_name", " ")).alias("w"))
    words = words.select("entity_id", F.explode(F.array("w", F.concat("w", F.lit("s")), F.concat("w", F.lit("ing")))).alias("term"))
    return words.groupBy("entity_id", "term").agg((1.0 / F.count("*") + F.length("term")).alias("score"))


def trial_phase_max(spark, d):
    p = star.table(spark, d, "part")
    trials = p.select(F.concat_ws("|", "p_brand", "p_name").alias("interventions"), F.concat_ws("|", "p_type", F.lit("other")).alias("conditions"), F.element_at(F.array(*map(F.lit, ["NA", "EARLY_PHASE1", "PHASE1", "PHASE2", "PHASE2|PHASE3", "PHASE4"])), (F.col("p_size") % 6 + 1).cast("int")).alias("phases"))
    drugs = p.select(F.col("p_brand").alias("name"), F.col("p_brand").alias("entity_id")).distinct()
    diseases = p.select(F.lower("p_type").alias("name"), F.col("p_type").alias("entity_id")).distinct()
    return statistics.trial_phases(trials, drugs, diseases)


def phase_left_join(spark, d):
    panel = results.overview(_facts(spark, d), "NATION_3", ["Brand"]).where("relation = 'treats'").select(F.col("other_id").alias("drug"), "n")
    return statistics.with_phase(panel, trial_phase_max(spark, d).where("disease = 'ECONOMY'").select("drug", "phase"), ["drug"])


def _log(spark, d):
    return star.query_log(spark, d)


def _chains(spark, d, types=("Nation", "Brand")):
    return statistics.keyword_chains(statistics.schema_support(star.predication(spark, d)), list(types))


def best_entity_type(spark, d):
    tags = star.tag(spark, d)
    other = tags.where("start_pos < 40").withColumn("ent_type", F.lit("Alias"))
    ids = star.ontology(spark, d).select(F.col("descriptor_id").alias("ent_id"))
    return statistics.best_types(tags.where("end_pos > 39").unionByName(other), ids)


def network(spark, d):
    f = _facts(spark, d).groupBy(F.col("subject_id").alias("source"), F.col("object_id").alias("target")).agg(F.count("*").alias("n"))
    ends = f.select(F.col("source").alias("node"), F.lit("source").alias("type"), "n").unionByName(f.select(F.col("target").alias("node"), F.lit("target").alias("type"), "n"))
    shown = suggest.top_nodes(ends.groupBy("node", "type").agg(F.sum("n").alias("n")), 5).select("node")
    return suggest.visible_network(f, shown).select("source", "target", "n")


QUERIES = {
    "explain_document": explain_document,
    "explain_merged": explain_merged,
    "explanations_shown": explanations_shown,
    "provenance": provenance_sentences,
    "corpus_size": lambda s, d: scoring.corpus_size(star.document(s, d)),
    "idf": lambda s, d: _r(scoring.idf(star.tag(s, d), star.document(s, d)), "idf"),
    "entity_positions": lambda s, d: scoring.positions(star.tag(s, d)),
    "coverage": lambda s, d: _r(_concepts(s, d).select(*DOC, "ent_id", "coverage", "tf"), "coverage", "tf"),
    "edge_score": lambda s, d: _r(_edges(s, d).select(*DOC, "subject_id", "relation", "object_id", "score"), "score"),
    "statement_confidence": lambda s, d: _r(scoring.confidences(star.predication(s, d), ["interacts"]), "confidence"),
    "document_graph": lambda s, d: _r(scoring.document_graph(_edges(s, d)), "score"),
    "concept_core": lambda s, d: _r(scoring.concept_core(_concepts(s, d).where("document_id % 100 = 0")).select("document_id", "ent_id", "score"), "score"),
    "concept_core_all": lambda s, d: _r(scoring.concept_core(_concepts(s, d), scoring.MAX_SUPPORT).select(*DOC, "ent_id", "score"), "score"),
    "statement_core": lambda s, d: scoring.statement_core(_edges(s, d).withColumn("score", F.round("score", 9))).select(*DOC, "a", "b", "relation", "score"),
    "first_stage": first_stage,
    "recommendations": recommendations,
    "representative_sentence": lambda s, d: scoring.representative_sentences(star.predication(s, d), _edges(s, d).withColumn("score", F.round("score", 9))).select(*DOC, "a", "b", "sentence_no"),
    "document_graph_top": lambda s, d: document_graph_top(s, d).select(*DOC, "a", "b", "label", F.col("rank").cast("long").alias("rank")),
    "document_graph_nodes": lambda s, d: scoring.nodes_of(document_graph_top(s, d)),
    "confidence_rounded": confidence_rounded,
    "keyword_sample": keyword_sample,
    "keyword_stems": lambda s, d: statistics.shortest_words(_scored(s, d).select(F.col("term").alias("word"))),
    "keyword_merged": lambda s, d: _r(statistics.merged_keywords(_scored(s, d)), "score"),
    "keyword_chains": lambda s, d: _chains(s, d, ("Nation", "Brand", "Segment")),
    "dynamic_cutoff": dynamic_cutoff,
    "core_overlap": core_overlap,
    "explanation_graph": explanation_graph,
    "schema_support": lambda s, d: statistics.schema_support(star.predication(s, d)),
    "type_cooccurrence": lambda s, d: statistics.type_cooccurrence(star.tag(s, d)),
    "best_entity_type": best_entity_type,
    "keyword_pairs": _chains,
    "keyword_suggestions": lambda s, d: statistics.suggestions(_chains(s, d)),
    "trial_phase_max": trial_phase_max,
    "phase_left_join": phase_left_join,
    "stopwords_topk": lambda s, d: statistics.frequent_terms(star.table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("term")), 10),
    "keyword_weights": lambda s, d: statistics.keyword_weights(star.tag(s, d).groupBy(F.col("ent_type").alias("entity_id"), F.col("ent_id").alias("term")).agg(F.count("*").cast("double").alias("score"))),
    "top_values_by_period": lambda s, d: statistics.top_values(_log(s, d), AS_OF),
    "occurrence_counters": lambda s, d: statistics.occurrence_counters(_log(s, d), AS_OF),
    "days_ago_counts": lambda s, d: statistics.days_ago(_log(s, d), AS_OF, 7),
    "suggestions": lambda s, d: statistics.log_suggestions(_log(s, d)),
    "log_profile": lambda s, d: statistics.log_profile(_log(s, d).withColumn("query_string", F.when(F.col("query_string") == "click", F.concat("query_string", F.lit("_AND_x"))).otherwise(F.col("query_string")))),
    "docs_per_collection": lambda s, d: scoring.corpus_size(star.document(s, d)),
    "tags_having": lambda s, d: statistics.tags_of_types(star.tag(s, d), 1000),
    "statements_per_relation": lambda s, d: statistics.statements_by(star.predication(s, d).where("relation IS NOT NULL"), "relation"),
    "relation_by_extraction": lambda s, d: statistics.statements_by(star.predication(s, d).withColumn("extraction_type", F.concat(F.lit("S"), "subject_type")), "relation", "extraction_type"),
    "autocomplete_prefix": lambda s, d: suggest.complete(_index(s, d).select(F.col("synonym").alias("term")), "Nation_1 treats x.nation_1"),
    "plural_pruning": lambda s, d: suggest.without_plurals(star.table(s, d, "part").select(F.explode(F.array("p_name", F.concat("p_name", F.lit("s")))).alias("term")).distinct()),
    "listed_overview": lambda s, d: suggest.listed(results.overview(_facts(s, d), "Brand#2", ["Nation"]), "other_id", "N_1").select("relation", "other_id", "n"),
    "visible_network": network,
}

_C = "document_collection, document_id"
_FX = {
    "sup": "SELECT ent_id, ent_type, count(DISTINCT (document_collection, document_id)) AS support FROM fx_tag GROUP BY ALL",
    "idfs": "SELECT ent_id, ent_type, support, ln(n / support) / ln(n) AS idf FROM sup, (SELECT CAST(count(*) AS DOUBLE) AS n FROM fx_document)",
    "con": f"SELECT p.document_collection, p.document_id, ent_id, ent_type, mentions, first_pos, last_pos, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (last_pos - first_pos) / CAST(length(title) * 5 AS DOUBLE))) AS coverage, mentions / CAST(total AS DOUBLE) AS tf, support, idf FROM (SELECT {_C}, ent_id, ent_type, count(*) AS mentions, min(start_pos) AS first_pos, max(end_pos) AS last_pos FROM fx_tag GROUP BY ALL) p JOIN (SELECT {_C}, count(*) AS total FROM fx_tag GROUP BY ALL) USING ({_C}) JOIN fx_document USING ({_C}) JOIN idfs USING (ent_id, ent_type)",
}
_W = "CASE relation WHEN 'interacts' THEN 0.5 WHEN 'decreases' THEN 0.5 WHEN 'associated' THEN 0.25 ELSE 1.0 END"
_FX["edg"] = f"SELECT s.*, least(coalesce(a.coverage, 0), coalesce(b.coverage, 0)) * confidence * CAST({_W} AS DOUBLE) * (0.5::DOUBLE * (coalesce(a.tf * a.idf, 0) + coalesce(b.tf * b.idf, 0))) AS score FROM (SELECT {_C}, subject_id, subject_type, relation, object_id, object_type, max(CAST(confidence AS DOUBLE)) AS confidence FROM fx_predication WHERE relation IS NOT NULL GROUP BY ALL) s LEFT JOIN con a ON s.document_id = a.document_id AND s.document_collection = a.document_collection AND subject_id = a.ent_id AND subject_type = a.ent_type LEFT JOIN con b ON s.document_id = b.document_id AND s.document_collection = b.document_collection AND object_id = b.ent_id AND object_type = b.ent_type"
_FX["core"] = f"SELECT * FROM (SELECT {_C}, least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, relation, score, row_number() OVER (PARTITION BY {_C}, least(subject_id, object_id), greatest(subject_id, object_id) ORDER BY score DESC, relation, subject_id) AS r FROM edg) WHERE r = 1"

_FX["dg"] = f"SELECT {_C}, least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, array_to_string(list_sort(list(DISTINCT relation)), '|') AS label, round(max(score), 9) AS score FROM edg GROUP BY {_C}, least(subject_id, object_id), greatest(subject_id, object_id)"
_QC = "query_collection, query_id"
_FX["qfst"] = f"SELECT {_QC}, {_C}, round(s / max(s) OVER (PARTITION BY {_QC}), 6) AS score FROM (SELECT {_QC}, t.document_collection, t.document_id, sum(w) AS s FROM (SELECT DISTINCT {_C}, ent_id, ent_type FROM fx_tag) t JOIN (SELECT document_collection AS query_collection, document_id AS query_id, ent_id, ent_type, coverage * tf * idf AS w FROM con WHERE document_id % 100 = 0 AND coverage * tf * idf > 0) USING (ent_id, ent_type) GROUP BY ALL)"
_FX["qrank"] = f"SELECT *, row_number() OVER (PARTITION BY {_QC} ORDER BY score DESC, document_id DESC, document_collection DESC) AS rank, min(score) OVER (PARTITION BY {_QC}) AS low FROM qfst"
_FX["qcut"] = f"SELECT * FROM (SELECT *, max(CASE WHEN rank = 51 THEN score END) OVER (PARTITION BY {_QC}) AS tie FROM qrank) WHERE rank <= 100 AND (rank <= 50 OR (low < tie AND score >= tie))"
_FX["qother"] = "SELECT * FROM qcut WHERE query_id <> document_id OR query_collection <> document_collection"
_FX["qcand"] = f"SELECT {_QC}, core.* FROM core JOIN (SELECT {_QC}, {_C} FROM qcut WHERE query_id <> document_id OR query_collection <> document_collection) USING ({_C})"
_FX["qown"] = "SELECT document_collection AS query_collection, document_id AS query_id, a, b, relation, score FROM core WHERE document_id % 100 = 0"


def _rounded_sql(x: str) -> str:
    m = f"(CAST(({x} - floor({x})) * 1152921504606846976 AS HUGEINT) * 100)"
    return f"(floor({x}) * 100 + {m} // 1152921504606846976 + CASE WHEN {m} % 1152921504606846976 > 576460752303423488 OR ({m} % 1152921504606846976 = 576460752303423488 AND ({m} // 1152921504606846976) % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE"


def _q(body: str, *names: str) -> str:
    return star.sql(body, **{n: _FX[n] for n in names})


_ALL = ("sup", "idfs", "con")
_PHASE = "SELECT p_brand AS drug, p_type AS disease, max(CASE p_size % 6 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 4 END) AS phase FROM part GROUP BY ALL"
_D = f"DATE '{AS_OF}'"
_PROBE_SQL = "(subject_id IN ('NATION_1', 'NATION_2', 'NATION_3', 'Brand#2') AND object_id IN ('NATION_1', 'NATION_2', 'NATION_3', 'Brand#2') AND pattern = 0) OR (pattern = 1 AND relation IN ('interacts', 'metabolises', 'inhibits') AND subject_id IN ('Brand#3', 'Brand#4', 'NATION_5', 'NATION_6') AND object_id IN ('Brand#3', 'Brand#4', 'NATION_5', 'NATION_6'))"
_SCHEMA = "SELECT subject_type, relation, object_type, count(DISTINCT (document_collection, document_id)) AS support FROM fx_predication WHERE relation IS NOT NULL GROUP BY ALL"
_CHAINS = "SELECT 'Nation-Brand' AS chain, relation AS relations, support FROM sch WHERE subject_type = 'Nation' AND object_type = 'Brand' UNION ALL VALUES ('Nation-Brand', 'associated', 0)"
_REL = "SELECT * FROM sch UNION ALL SELECT a, 'associated', b, 0 FROM (VALUES ('Nation', 'Brand'), ('Brand', 'Nation'), ('Nation', 'Segment'), ('Segment', 'Nation'), ('Brand', 'Segment'), ('Segment', 'Brand')) v(a, b)"
_PERM = "SELECT k, o, list_transform(o, lambda i: ['Nation', 'Brand', 'Segment'][i + 1]) AS t FROM (VALUES (0, [0, 1, 2]), (1, [0, 2, 1]), (2, [1, 0, 2]), (3, [1, 2, 0]), (4, [2, 0, 1]), (5, [2, 1, 0])) v(k, o)"
_CH3 = "SELECT chain, relations, support FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY k) AS r FROM (SELECT k, array_to_string(t, '-') AS chain, x.relation || ',' || y.relation AS relations, CASE WHEN x.support > 0 THEN least(x.support, y.support) ELSE y.support END AS support, list_sort([least(o[1], o[2]) || '/' || greatest(o[1], o[2]) || x.relation, least(o[2], o[3]) || '/' || greatest(o[2], o[3]) || y.relation]) AS canon FROM perm JOIN rel x ON x.subject_type = t[1] AND x.object_type = t[2] JOIN rel y ON y.subject_type = t[2] AND y.object_type = t[3])) WHERE r = 1"
_SCORED = "SELECT entity_id, term, 1.0::DOUBLE / count(*) + length(term) AS score FROM (SELECT p_brand AS entity_id, unnest([w, w || 's', w || 'ing']) AS term FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)) GROUP BY entity_id, term"
_STEMS = f"stems AS MATERIALIZED ({porter_sql(f'SELECT term FROM ({_SCORED})', 'term')})"
_JOINED = lambda c: f"list_reduce(list({c} ORDER BY subject_id, relation, object_id), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || '//' || x END) AS {c}"
_EDGE2 = "SELECT subject_id AS source, object_id AS target, count(*) AS n FROM facts GROUP BY ALL"
ORACLE = {
    "explain_document": star.sql(f"SELECT document_id, pattern, subject_id, relation, object_id, sentence_no, round(confidence, 2)::DOUBLE AS confidence FROM fx_predication, (SELECT unnest([0, 1]) AS pattern) WHERE document_id IN (SELECT document_id FROM facts WHERE subject_id IN ('NATION_1', 'NATION_2', 'NATION_3') AND object_id = 'Brand#2') AND ({_PROBE_SQL})"),
    "explanations_shown": star.sql(f"SELECT document_id, pattern, subject_id, relation, object_id, sentence_no, {_rounded_sql('c')} AS confidence FROM (SELECT *, CAST(confidence AS DOUBLE) / 8 AS c FROM fx_predication, (SELECT unnest([0, 1]) AS pattern) WHERE relation IS NOT NULL AND ({_PROBE_SQL}))"),
    "explain_merged": star.sql(f"SELECT document_id, pattern, sentence_no, {_JOINED('subject_id')}, {_JOINED('relation')}, {_JOINED('object_id')}, round(max(confidence), 6)::DOUBLE AS confidence, count(*) AS statements FROM fx_predication, (SELECT unnest([0, 1]) AS pattern) WHERE relation IS NOT NULL AND ({_PROBE_SQL}) GROUP BY document_id, pattern, sentence_no"),
    "provenance": star.sql("SELECT 0 AS pattern, document_id || '/' || subject_id || '/' || object_id || '/' || sentence_no AS predication_id, subject_id, relation, object_id, CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || '[...]' ELSE text END AS sentence FROM (SELECT DISTINCT document_id, subject_id, relation, object_id, sentence_no FROM fx_predication WHERE relation = 'treats' AND object_id = 'Brand#2' AND subject_id IN ('NATION_3', 'NATION_4')) JOIN documents ON doc_id = document_id"),
    "corpus_size": star.sql("SELECT document_collection, count(*) AS n_documents FROM fx_document GROUP BY 1"),
    "idf": _q("SELECT ent_id, ent_type, support, round(idf, 6) AS idf FROM idfs", "sup", "idfs"),
    "entity_positions": star.sql(f"SELECT {_C}, ent_id, ent_type, count(*) AS mentions, min(start_pos) AS first_pos, max(end_pos) AS last_pos FROM fx_tag GROUP BY ALL"),
    "coverage": _q(f"SELECT {_C}, ent_id, round(coverage, 6) AS coverage, round(tf, 6) AS tf FROM con", *_ALL),
    "edge_score": _q(f"SELECT {_C}, subject_id, relation, object_id, round(score, 6) AS score FROM edg", *_ALL, "edg"),
    "statement_confidence": star.sql(f"SELECT {_C}, subject_id, subject_type, relation, object_id, object_type, round(max(CAST(confidence AS DOUBLE)), 6) AS confidence FROM (SELECT * FROM fx_predication WHERE relation IS NOT NULL UNION ALL SELECT document_id, document_collection, object_id, object_type, relation, subject_id, subject_type, confidence, sentence_no FROM fx_predication WHERE relation = 'interacts') GROUP BY ALL"),
    "document_graph": _q(f"SELECT {_C}, least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, array_to_string(list_sort(list(DISTINCT relation)), '|') AS label, round(max(score), 6) AS score FROM edg GROUP BY ALL".replace("GROUP BY ALL", f"GROUP BY {_C}, least(subject_id, object_id), greatest(subject_id, object_id)"), *_ALL, "edg"),
    "concept_core": _q(f"SELECT document_id, ent_id, round(coverage * tf * idf, 6) AS score FROM con WHERE document_id % 100 = 0 AND coverage * tf * idf > 0", *_ALL),
    "concept_core_all": _q(f"SELECT {_C}, ent_id, round(coverage * tf * idf, 6) AS score FROM con WHERE coverage * tf * idf > 0 AND support <= {scoring.MAX_SUPPORT}", *_ALL),
    "statement_core": _q(f"SELECT {_C}, a, b, relation, round(score, 9) AS score FROM core", *_ALL, "edg", "core").replace("ORDER BY score DESC, relation, subject_id", "ORDER BY round(score, 9) DESC, relation, subject_id"),
    "first_stage": _q(f"SELECT {_QC}, {_C}, score FROM qrank WHERE rank <= 101", *_ALL, "qfst", "qrank"),
    "dynamic_cutoff": _q(f"SELECT {_QC}, {_C}, score, rank FROM qcut", *_ALL, "qfst", "qrank", "qcut"),
    "core_overlap": _q(f"SELECT {_QC}, c.document_collection, c.document_id, round(sum(i.score), 6) AS score, count(*) AS shared FROM qcand c JOIN qown i USING ({_QC}, a, b) GROUP BY ALL", *_ALL, "edg", "core", "qfst", "qrank", "qcut", "qcand", "qown"),
    "explanation_graph": _q(f"SELECT {_QC}, {_C}, a, b, both_ AS both, a_shared, b_shared FROM (SELECT *, row_number() OVER (PARTITION BY {_QC}, {_C} ORDER BY both_ DESC, s DESC, a, b) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {_QC}, {_C}, both_ ORDER BY s DESC, a, b) AS k FROM (SELECT *, ({_QC}, a, b) IN (SELECT ({_QC}, a, b) FROM qown) AS both_ FROM (SELECT {_QC}, {_C}, a, b, round(score, 9) AS s, ({_QC}, a) IN (SELECT ({_QC}, unnest([a, b])) FROM qown) AS a_shared, ({_QC}, b) IN (SELECT ({_QC}, unnest([a, b])) FROM qown) AS b_shared FROM qcand) WHERE a_shared OR b_shared)) WHERE NOT both_ OR k <= 7) WHERE rank <= 13", *_ALL, "edg", "core", "qfst", "qrank", "qcut", "qcand", "qown").replace("ORDER BY score DESC, relation, subject_id", "ORDER BY round(score, 9) DESC, relation, subject_id"),
    "recommendations": _q(f"SELECT {_QC}, q.document_collection, q.document_id, rank, round(sum(i.score), 6) AS score, count(*) AS shared FROM qother q JOIN core c ON c.document_id = q.document_id AND c.document_collection = q.document_collection JOIN core i ON i.document_id = query_id AND i.document_collection = query_collection AND i.a = c.a AND i.b = c.b GROUP BY {_QC}, q.document_collection, q.document_id, rank", *_ALL, "edg", "core", "qfst", "qrank", "qcut", "qother"),
    "representative_sentence": _q(f"SELECT {_C}, a, b, sentence_no FROM (SELECT *, row_number() OVER (PARTITION BY {_C}, a, b ORDER BY s, sentence_no) AS r FROM (SELECT {_C}, least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, round(score, 9) AS s, sentence_no FROM edg JOIN (SELECT {_C}, subject_id, subject_type, relation, object_id, object_type, sentence_no FROM fx_predication) USING ({_C}, subject_id, subject_type, relation, object_id, object_type))) WHERE r = 1", *_ALL, "edg"),
    "document_graph_top": _q(f"SELECT {_C}, a, b, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY score DESC, a, b) AS rank FROM dg) WHERE rank <= 3", *_ALL, "edg", "dg"),
    "document_graph_nodes": _q(f"SELECT DISTINCT {_C}, unnest([a, b]) AS node FROM (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY score DESC, a, b) AS rank FROM dg) WHERE rank <= 3", *_ALL, "edg", "dg"),
    "confidence_rounded": f"SELECT DISTINCT round(x, 6) AS x, {_rounded_sql('x')} AS x2, round(y, 6) AS y, {_rounded_sql('y')} AS y2 FROM (SELECT CAST(l_quantity AS DOUBLE) / 400 AS x, l_linenumber + CAST(l_quantity AS DOUBLE) / 1000 AS y FROM lineitem)",
    "keyword_sample": star.sql(f"SELECT ent_id, ent_type, {_C} FROM (SELECT *, row_number() OVER (PARTITION BY ent_id, ent_type ORDER BY md5('7:' || document_collection || ':' || document_id), document_id) AS r FROM (SELECT DISTINCT {_C}, ent_id, ent_type FROM fx_tag)) WHERE r <= 20"),
    "keyword_stems": f"WITH {_STEMS} SELECT stem, word FROM (SELECT stem, word, row_number() OVER (PARTITION BY stem ORDER BY length(word), word) AS r FROM stems) WHERE r = 1",
    "keyword_merged": f"WITH {_STEMS} SELECT entity_id, term, round(low, 6) AS score FROM (SELECT entity_id, term, min(score) OVER (PARTITION BY entity_id, stem) AS low, row_number() OVER (PARTITION BY entity_id, stem ORDER BY length(term), term) AS r FROM ({_SCORED}) JOIN stems ON word = term) WHERE r = 1",
    "keyword_chains": star.sql("SELECT * FROM ch3", sch=_SCHEMA, rel=_REL, perm=_PERM, ch3=_CH3),
    "schema_support": star.sql("SELECT * FROM sch", sch=_SCHEMA),
    "type_cooccurrence": star.sql(f"SELECT x.ent_type AS type_a, y.ent_type AS type_b, count(*) AS support FROM (SELECT DISTINCT {_C}, ent_type FROM fx_tag) x JOIN (SELECT DISTINCT {_C}, ent_type FROM fx_tag) y USING ({_C}) GROUP BY ALL"),
    "best_entity_type": star.sql("SELECT ent_id, ent_type, support FROM (SELECT *, row_number() OVER (PARTITION BY ent_id ORDER BY support DESC, ent_type) AS r FROM (SELECT ent_id, ent_type, count(DISTINCT (document_collection, document_id)) AS support FROM (SELECT document_collection, document_id, ent_id, ent_type FROM fx_tag WHERE end_pos > 39 UNION ALL SELECT document_collection, document_id, ent_id, 'Alias' FROM fx_tag WHERE start_pos < 40) WHERE ent_id IN (SELECT descriptor_id FROM fx_ontology) GROUP BY ALL)) WHERE r = 1"),
    "keyword_pairs": star.sql("SELECT * FROM ch", sch=_SCHEMA, ch=_CHAINS),
    "keyword_suggestions": star.sql("(SELECT * FROM ch WHERE relations <> 'associated' ORDER BY support DESC, chain, relations LIMIT 2) UNION ALL (SELECT * FROM ch WHERE relations = 'associated' ORDER BY support DESC, chain, relations LIMIT 1)", sch=_SCHEMA, ch=_CHAINS),
    "trial_phase_max": star.sql("SELECT * FROM ph", ph=_PHASE),
    "phase_left_join": star.sql("SELECT o.drug, n, coalesce(phase, -1) AS phase FROM (SELECT object_id AS drug, count(DISTINCT (document_collection, document_id)) AS n FROM facts WHERE subject_id = 'NATION_3' AND relation = 'treats' GROUP BY 1) o LEFT JOIN (SELECT * FROM ph WHERE disease = 'ECONOMY') p ON o.drug = p.drug", ph=_PHASE),
    "stopwords_topk": "SELECT term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part) GROUP BY 1 ORDER BY n DESC, term LIMIT 10",
    "keyword_weights": star.sql("SELECT entity_id, term, CAST(8 - floor(coalesce(7 * (hi - score) / nullif(hi - lo, 0), 0)) AS INTEGER) AS weight FROM (SELECT *, min(score) OVER (PARTITION BY entity_id) AS lo, max(score) OVER (PARTITION BY entity_id) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, term) AS r FROM (SELECT ent_type AS entity_id, ent_id AS term, CAST(count(*) AS DOUBLE) AS score FROM fx_tag GROUP BY ALL)) WHERE r <= 20)"),
    "top_values_by_period": star.sql(f"SELECT period, query_string, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, query_string) AS r FROM (SELECT period, query_string, count(*) AS n FROM (SELECT 'today' AS period, query_string FROM fx_query_log WHERE log_date = {_D} UNION ALL SELECT 'week', query_string FROM fx_query_log WHERE week(log_date) = week({_D}) AND year(log_date) = year({_D}) UNION ALL SELECT 'month', query_string FROM fx_query_log WHERE date_trunc('month', log_date) = date_trunc('month', {_D}) UNION ALL SELECT 'year', query_string FROM fx_query_log WHERE year(log_date) = year({_D}) UNION ALL SELECT 'all', query_string FROM fx_query_log) GROUP BY ALL)) WHERE r <= 5"),
    "occurrence_counters": star.sql(f"SELECT query_string, count(*) FILTER (log_date = {_D}) AS n_t, count(*) FILTER (year(log_date) = year({_D}) AND week(log_date) = week({_D})) AS n_tw, count(*) FILTER (year(log_date) = year({_D}) AND month(log_date) = month({_D})) AS n_tm, count(*) FILTER (year(log_date) = year({_D}) AND month(log_date) = month({_D}) - 1) AS n_lm, count(*) FILTER (year(log_date) = year({_D})) AS n_ty, count(*) FILTER (year(log_date) = year({_D}) - 1) AS n_ly FROM fx_query_log GROUP BY 1"),
    "days_ago_counts": star.sql(f"SELECT date_diff('day', log_date, {_D}) AS days_ago, count(*) AS n FROM fx_query_log WHERE date_diff('day', log_date, {_D}) BETWEEN 0 AND 7 GROUP BY 1"),
    "suggestions": star.sql("SELECT lower(trim(query_string)) AS suggestion, count(*) AS n FROM fx_query_log GROUP BY 1"),
    "log_profile": star.sql("SELECT CAST(year(log_date) AS INTEGER) AS year, count(*) AS n, avg(CASE WHEN query_string = 'click' THEN 1 ELSE 0 END) AS share_of_several FROM fx_query_log GROUP BY 1"),
    "docs_per_collection": star.sql("SELECT document_collection, count(*) AS n_documents FROM fx_document GROUP BY 1"),
    "tags_having": star.sql("SELECT ent_type, count(*) AS n FROM fx_tag GROUP BY 1 HAVING count(*) >= 1000"),
    "statements_per_relation": star.sql("SELECT relation, count(*) AS n FROM fx_predication WHERE relation IS NOT NULL GROUP BY 1"),
    "relation_by_extraction": star.sql("SELECT relation, 'S' || subject_type AS extraction_type, count(relation) AS n FROM fx_predication GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY relation, subject_type")),
    "autocomplete_prefix": "SELECT term FROM (SELECT DISTINCT n_name AS term FROM nation WHERE starts_with(lower(n_name), 'nation_1') ORDER BY lower(n_name), n_name LIMIT 10)",
    "plural_pruning": "WITH t AS (SELECT DISTINCT unnest([p_name, p_name || 's']) AS term FROM part) SELECT term FROM t WHERE term NOT IN (SELECT term || 's' FROM t WHERE length(term) >= 5)",
    "listed_overview": star.sql("SELECT relation, subject_id AS other_id, count(DISTINCT (document_collection, document_id)) AS n FROM facts WHERE object_id = 'Brand#2' AND subject_type = 'Nation' AND contains(lower(subject_id), 'n_1') GROUP BY ALL"),
    "visible_network": star.sql("SELECT * FROM e WHERE source IN (SELECT source FROM e GROUP BY 1 ORDER BY sum(n) DESC, source LIMIT 5) AND target IN (SELECT target FROM e GROUP BY 1 ORDER BY sum(n) DESC, target LIMIT 5)", e=_EDGE2),
}
