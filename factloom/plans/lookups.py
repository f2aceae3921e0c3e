"""Queries of stored look-up structures: the completion dictionary and substring search. Each is written once a session and folder of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dictionary, qgrams, results, suggest
from ..sources import shared, star
from ..streaming import usage

PREFIXES = ["re", "Blue ", "supp", "supplier_1", "brand#1", "hot gear", "zz", "n", "x.nation_2"]


def _terms(spark, d):
    """Names of products, brands, nations, suppliers and customers' numbers, as users would type them."""
    t = lambda name, column: star.table(spark, d, name).select(F.col(column).alias("term"))
    parts = star.table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_partkey").alias("term"))
    return reduce(DataFrame.unionByName, [t("part", "p_name"), parts, t("part", "p_brand"), t("nation", "n_name"), t("supplier", "s_name")])


def _dictionary(spark, d):
    return shared.once(spark, "dictionary", d, lambda path: dictionary.write(_terms(spark, d), path, per_file=300), lambda path: dictionary.Dictionary(spark, path))


def completion_terms(spark, d):
    """All names, decoded from the stored dictionary."""
    return _dictionary(spark, d).terms()


def completions(spark, d):
    own = _dictionary(spark, d)
    return reduce(DataFrame.unionByName, [own.complete(p).select(F.lit(p).alias("typed"), "term") for p in PREFIXES])


def completions_scanned(spark, d):
    """The same without the dictionary."""
    terms = _terms(spark, d)
    return reduce(DataFrame.unionByName, [suggest.complete(terms, p).select(F.lit(p).alias("typed"), "term") for p in PREFIXES])


def _search(spark, d):
    """Equal titles are posted once, under the title itself."""
    titles = star.document(spark, d).select("title").distinct()
    return shared.once(spark, "qgrams", d, lambda path: qgrams.write(titles, "title", "title", path, 4), lambda path: qgrams.Search(spark, path))


def _needles(spark, d):
    """Pieces of titles of one to eleven letters, and some that no title holds."""
    titles = star.document(spark, d).select("title").distinct()
    pieces = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda n: F.substring("title", n, n))
    return titles.select(F.explode(F.concat(pieces, F.array(F.concat(F.substring("title", 1, 4), F.lit("zq"))))).alias("needle")).distinct()


def substring_hits(spark, d):
    """How many titles hold each needle."""
    titles = star.document(spark, d).groupBy("title").agg(F.count("*").alias("n"), F.sum("document_id").alias("total"))
    found = _search(spark, d).find(_needles(spark, d), titles, "title", "title")
    return found.join(titles.withColumnRenamed("title", "id"), "id").groupBy("needle").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def compressed_tree(spark, d):
    """Customers under segments under nations under regions; some inner nodes have documents of their own."""
    c = star.table(spark, d, "customer").join(star.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    number = F.concat_ws(".", F.concat(F.lit("R"), "n_regionkey"), F.concat(F.lit("N"), "n_nationkey"), F.substring("c_mktsegment", 1, 2), F.concat(F.lit("C"), F.col("c_custkey") % 997), F.col("c_custkey").cast("string"))
    parts = F.split("number", r"\.")
    nodes = c.select(number.alias("number")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("node")).distinct()
    own = (F.size(F.split("node", r"\.")) == 5) | (F.crc32(F.col("node").cast("binary")) % 11 == 0)
    return results.compressed_paths(nodes.select("node", own.alias("own")))


def explained_entities(spark, d):
    """Names of every brand: products, their types, and both together in several spellings."""
    p = star.table(spark, d, "part")
    names = F.explode(F.array("p_name", F.concat_ws(", ", "p_name", "p_type"), F.concat_ws(" ", F.initcap("p_name"), F.lower("p_type"), "p_size"), F.concat_ws("-", "p_type", "p_name"), F.col("p_type"))).alias("name")
    shown = suggest.explanations(p.select(F.col("p_brand").alias("entity_id"), names), 12)
    return shown.select("entity_id", F.array_join("names", "; ").alias("names"), "n")


def top_of_periods(spark, d):
    """The most frequent events of every day, week, month, year and of all time."""
    events = star.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return usage.top_of_periods(usage.period_counts(events), 3).withColumn("rank", F.col("rank").cast("long"))


QUERIES = {"top_of_periods": top_of_periods, "compressed_tree": compressed_tree, "explained_entities": explained_entities, "completion_terms": completion_terms, "completions": completions, "completions_scanned": completions_scanned, "substring_hits": substring_hits}
_TERMS = "SELECT p_name AS term FROM part UNION SELECT p_name || ' ' || p_partkey FROM part UNION SELECT p_brand FROM part UNION SELECT n_name FROM nation UNION SELECT s_name FROM supplier"
_TYPED = ", ".join(f"('{p}', '{p.split('.')[-1].strip().lower()}')" for p in PREFIXES)
_COMPLETED = f"SELECT typed, term FROM (SELECT typed, term, row_number() OVER (PARTITION BY typed ORDER BY lower(term), term) AS r FROM (VALUES {_TYPED}) t(typed, prefix) JOIN ({_TERMS}) ON starts_with(lower(term), prefix) AND length(prefix) >= 2) WHERE r <= 10"
_CRC = """list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(node))), lambda i: CAST(('0x' || substr(hex(encode(node)), CAST(2 * i + 1 AS INT), 2)) AS BIGINT))),
  lambda c, x: xor(t[CAST(xor(c, x) & 255 AS INT) + 1], c >> 8))"""
ORACLE = {
    "top_of_periods": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, start ORDER BY n DESC, value) AS rank FROM (SELECT period, CASE WHEN period <> 'ever' THEN CAST(date_trunc(CASE period WHEN 'ever' THEN 'year' ELSE period END, ts) AS DATE) END AS start, event_type AS value, count(*) AS n
  FROM events, (SELECT unnest(['day', 'week', 'month', 'year', 'ever']) AS period) GROUP BY ALL)) WHERE rank <= 3""",
    "compressed_tree": f"""WITH RECURSIVE bits(n, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
step AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
numbers AS (SELECT ['R' || n_regionkey, 'N' || n_nationkey, substr(c_mktsegment, 1, 2), 'C' || (c_custkey % 997), CAST(c_custkey AS VARCHAR)] AS p FROM customer JOIN nation ON c_nationkey = n_nationkey),
nodes AS (SELECT DISTINCT array_to_string(p[1:n], '.') AS node, n FROM numbers, range(1, 6) r(n)),
marked AS (SELECT node, n = 5 OR xor({_CRC}, 4294967295) % 11 = 0 AS own FROM nodes, step),
kids AS (SELECT regexp_replace(node, '\\.[^.]*$', '') AS node, count(*) AS n, min(node) AS child FROM nodes WHERE n > 1 GROUP BY 1),
go AS (SELECT m.node, CASE WHEN NOT own AND k.n = 1 THEN child END AS child FROM marked m LEFT JOIN kids k USING (node)),
walk(node, shown, child) AS (SELECT node, node, child FROM go UNION ALL SELECT walk.node, walk.child, go.child FROM walk JOIN go ON go.node = walk.child)
SELECT node, shown FROM walk WHERE child IS NULL""",
    "explained_entities": """WITH names AS (SELECT DISTINCT entity_id, name, list_filter(string_split(regexp_replace(lower(regexp_replace(name, '[[:punct:]]', '', 'g')), ' +', ' ', 'g'), ' '), lambda w: w <> '') AS ws
  FROM (SELECT p_brand AS entity_id, unnest([p_name, p_name || ', ' || p_type, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || lower(p_type) || ' ' || p_size, p_type || '-' || p_name, p_type]) AS name FROM part)),
kept AS (SELECT entity_id, list(name ORDER BY name) AS a FROM names h WHERE NOT EXISTS (SELECT 1 FROM names g WHERE g.entity_id = h.entity_id AND g.name < h.name AND len(g.ws) <= len(h.ws) AND h.ws[1:len(g.ws)] = g.ws) GROUP BY entity_id)
SELECT entity_id, array_to_string(CASE WHEN len(a) > 12 THEN list_append(a[1:12], 'and ' || (len(a) - 12) || ' more') ELSE a END, '; ') AS names, len(a) AS n FROM kept""",
    "completion_terms": _TERMS,
    "completions": _COMPLETED,
    "completions_scanned": _COMPLETED,
    "substring_hits": star.sql("SELECT needle, count(*) AS n, CAST(sum(document_id) AS BIGINT) AS total FROM (SELECT DISTINCT unnest(list_concat(list_transform(range(1, 12), lambda n: substr(title, n, n)), [substr(title, 1, 4) || 'zq'])) AS needle FROM (SELECT DISTINCT title FROM fx_document)) JOIN fx_document ON contains(lower(title), lower(needle)) WHERE needle <> '' GROUP BY needle"),
}
