"""Queries of keyword extraction and stemming, and the stemmer once more as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stemming
from ..functions import text as T
from ..operators import keywords, statistics
from ..sources import star

SAMPLE, SEED = 100, 7
DOC = ["document_collection", "document_id"]


def document_keywords(spark, d):
    """The keywords of every document."""
    return keywords.document_keywords(star.text_document(spark, d).select("document_id", "text"), ["document_id"]).withColumn("score", F.round("score", 6))


def _sources(spark, d):
    return star.text_document(spark, d).select(*DOC, F.col("source").alias("ent_id"), F.lit("Source").alias("ent_type"))


def keyword_clouds(spark, d):
    """Weighted keywords of every source, from a sample of its documents."""
    return keywords.entity_keywords(_sources(spark, d), star.text_document(spark, d), SAMPLE, seed=SEED)


def _words(spark, d):
    """All words of all texts."""
    return star.text_document(spark, d).select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), 1)).alias("word")).distinct()


def word_stems(spark, d):
    return _words(spark, d).select("word", stemming.porter(F.col("word")).alias("stem"))


def shortest_words(spark, d):
    return statistics.shortest_words(_words(spark, d))


def porter_sql(words: str, word: str = "word") -> str:
    """A query of the distinct words of another with their stems, one step of the cascade a level."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    m0, m1, m2, vowel, short = f"^({c})?{v}{c}", f"^({c})?{v}{c}({v})?$", f"^({c})?{v}{c}{v}{c}", f"^({c})?[aeiouy]", f"^{c}[aeiouy][^aeiouwxy]$"
    has = lambda x, r: f"regexp_matches({x}, '{r}')"
    cut = lambda n, x="x": f"substr({x}, 1, length({x}) - {n})"
    double = f"({'|'.join(2 * x for x in 'bcdfghjkmnpqrtvwx')})$"

    def longest(rules, condition):
        cases = [f"WHEN ends_with(x, '{s}') THEN CASE WHEN {has(cut(len(s)), condition)} THEN {cut(len(s))} || '{p}' ELSE x END" for s, p in sorted(rules, key=lambda r: -len(r[0]))]
        return f"CASE {' '.join(cases)} ELSE x END"

    mended = f"CASE WHEN {has('y', '(at|bl|iz)$')} THEN y || 'e' WHEN {has('y', double)} THEN {cut(1, 'y')} WHEN {has('y', m1)} AND {has('y', short)} THEN y || 'e' ELSE y END"
    past = {n: f"(ends_with(x, '{e}') AND {has(cut(n), vowel)})" for e, n in (("ed", 2), ("ing", 3))}
    ion = f"CASE WHEN ends_with(x, 'ion') THEN CASE WHEN {has(cut(3), '[st]$')} AND {has(cut(3), m2)} THEN {cut(3)} ELSE x END ELSE {longest([(s, '') for s in stemming.STEP_4], m2)} END"
    steps = [
        f"CASE WHEN {has('x', '(ss|i)es$')} THEN {cut(2)} WHEN {has('x', '[^s]s$')} THEN {cut(1)} ELSE x END",
        f"CASE WHEN ends_with(x, 'eed') THEN CASE WHEN {has(cut(3), m0)} THEN {cut(1)} ELSE x END WHEN {past[2]} THEN '+' || {cut(2)} WHEN {past[3]} THEN '+' || {cut(3)} ELSE x END",
        f"CASE WHEN x[1] = '+' THEN {mended.replace('y,', 'substr(x, 2),').replace('y END', 'substr(x, 2) END').replace('THEN y ', 'THEN substr(x, 2) ').replace('length(y)', 'length(substr(x, 2))')} ELSE x END",
        f"CASE WHEN ends_with(x, 'y') AND {has(cut(1), vowel)} THEN {cut(1)} || 'i' ELSE x END",
        longest(stemming.STEP_2, m0),
        longest(stemming.STEP_3, m0),
        ion,
        f"CASE WHEN ends_with(x, 'e') AND ({has(cut(1), m2)} OR ({has(cut(1), m1)} AND NOT {has(cut(1), short)})) THEN {cut(1)} ELSE x END",
        f"CASE WHEN ends_with(x, 'll') AND {has('x', m2)} THEN {cut(1)} ELSE x END",
    ]
    sql = f"SELECT DISTINCT {word} AS word, CASE WHEN starts_with(lower({word}), 'y') THEN 'Y' || substr(lower({word}), 2) ELSE lower({word}) END AS x FROM ({words})"
    for s in steps:
        sql = f"SELECT word, {s} AS x FROM ({sql})"
    return f"SELECT word, CASE WHEN length(word) < 3 THEN lower(word) WHEN starts_with(lower(word), 'y') THEN 'y' || substr(x, 2) ELSE x END AS stem FROM ({sql})"


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)


def scored_sql(texts: str) -> str:
    """(k, term, score) of texts (k, text)."""
    return f"""SELECT k, term, round(s / (tf * (1 + s)), 9) AS score FROM (
  SELECT *, ln(ln(3 + middle)) * rel / ((greatest(acronyms, capitals) / (1 + ln(tf))) + (tf / (mean + spread)) / rel + (sentences / n_sentences::DOUBLE) / rel) AS s FROM (
  SELECT *, 0.5::DOUBLE + coalesce(left_words / nullif(lefts, 0)::DOUBLE, 0::DOUBLE) * tf / most::DOUBLE + 0.5::DOUBLE + coalesce(right_words / nullif(rights, 0)::DOUBLE, 0::DOUBLE) * tf / most::DOUBLE AS rel FROM (
  SELECT *, max(tf) OVER (PARTITION BY k) AS most, avg(CASE WHEN NOT stop THEN tf END) OVER (PARTITION BY k) AS mean, stddev_pop(CASE WHEN NOT stop THEN tf END) OVER (PARTITION BY k) AS spread FROM (
  SELECT k, term, term IN ({_STOP}) AS stop, count(*) AS tf, median(sentence) AS middle, count(DISTINCT sentence) AS sentences, count(l) AS lefts, count(DISTINCT l) AS left_words, count(r) AS rights, count(DISTINCT r) AS right_words,
    count(*) FILTER (WHERE upper(word) = word AND lower(word) <> word AND length(word) > 1) AS acronyms,
    count(*) FILTER (WHERE place > 1 AND upper(word[1]) = word[1] AND lower(word[1]) <> word[1]) AS capitals FROM (
  SELECT k, sentence, place, ws[place] AS word, lower(ws[place]) AS term, CASE WHEN place > 1 THEN lower(ws[place - 1]) END AS l, lower(ws[place + 1]) AS r FROM (
  SELECT *, unnest(range(1, len(ws) + 1)) AS place FROM (
  SELECT k, i - 1 AS sentence, regexp_extract_all(s[i], '[\\p{{L}}\\p{{N}}]+') AS ws FROM (SELECT k, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT k, regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+') AS s FROM ({texts})))))) GROUP BY k, term))
  JOIN (SELECT k, max(len(regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+'))) AS n_sentences FROM ({texts}) GROUP BY k) USING (k)
  WHERE NOT stop AND length(term) >= {keywords.LEAST_LENGTH} AND NOT regexp_matches(term, '^[0-9]+$')))"""


def suppressed_sql(scored: str, keep: int = 25) -> str:
    """Similarity counts code points, DuckDB's bytes: letters beyond ASCII are written as one byte each for it, which holds for the letters of these texts."""
    odd = "àâäçéèêëîïôöùûüßñóíúá¡¿ãõœæÿ"
    byte = "chr(1)" + "".join(f" || chr({i})" for i in range(2, len(odd) + 1))
    first = f"SELECT k, list_transform(list({{'s': score, 't': term}} ORDER BY score, term), lambda x: [x]) AS a FROM ({scored}) GROUP BY k"
    plain = lambda x: f"translate({x}, '{odd}', {byte})"
    kept = f"list_reduce(a, lambda acc, x: CASE WHEN len(acc) >= {keep} OR len(list_filter(acc, lambda y: jaro_similarity({plain('y.t')}, {plain('x[1].t')}) > 0.9)) > 0 THEN acc ELSE list_concat(acc, x) END)"
    return f"SELECT k, kept[rank].t AS term, kept[rank].s AS score, rank FROM (SELECT k, kept, unnest(range(1, len(kept) + 1)) AS rank FROM (SELECT k, {kept} AS kept FROM ({first})))"


_TEXTS = "SELECT source AS k, text FROM drawn JOIN documents USING (doc_id)"
_DRAWN = f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || lang || ':' || doc_id), doc_id) AS r FROM (SELECT DISTINCT doc_id, lang, source FROM documents)) WHERE r <= {SAMPLE}"
_VOCABULARY = "SELECT DISTINCT k, lower(unnest(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+'))) AS word FROM sampled"
_ALL_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents"
QUERIES = {"document_keywords": document_keywords, "keyword_clouds": keyword_clouds, "word_stems": word_stems, "shortest_words": shortest_words}
ORACLE = {
    "document_keywords": f"SELECT k AS document_id, term, round(score, 6) AS score, rank FROM ({suppressed_sql(scored_sql('SELECT doc_id AS k, text FROM documents'))})",
    "keyword_clouds": f"""WITH drawn AS ({_DRAWN}), sampled AS ({_TEXTS}), vocabulary AS ({_VOCABULARY}), best AS ({suppressed_sql(scored_sql("SELECT k, text FROM sampled"))}),
stems AS ({porter_sql("SELECT word FROM vocabulary UNION SELECT term FROM best")}),
shortest AS (SELECT k, stem, word FROM (SELECT k, stem, word, row_number() OVER (PARTITION BY k, stem ORDER BY length(word), word) AS r FROM vocabulary JOIN stems USING (word)) WHERE r = 1),
merged AS (SELECT k, stem, min(score) AS score FROM best JOIN stems ON best.term = stems.word WHERE NOT contains(lower(k), best.term) GROUP BY k, stem),
named AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score, term) AS r FROM (SELECT k, CASE WHEN word = stem || 's' THEN stem ELSE word END AS term, score FROM merged JOIN shortest USING (k, stem)))
SELECT 'Source:' || k AS entity_id, term, CAST(8 - floor(coalesce(7 * (score - min(score) OVER (PARTITION BY k)) / nullif(max(score) OVER (PARTITION BY k) - min(score) OVER (PARTITION BY k), 0), 0)) AS INTEGER) AS weight FROM named WHERE r <= 20""",
    "word_stems": porter_sql(_ALL_WORDS),
    "shortest_words": f"SELECT stem, word FROM (SELECT stem, word, row_number() OVER (PARTITION BY stem ORDER BY length(word), word) AS r FROM ({porter_sql(_ALL_WORDS)})) WHERE r = 1",
}
