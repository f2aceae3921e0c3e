"""Importance resampling towards a target text distribution, in Spark SQL alone.

Texts are cut into words, features are all runs of 1 to ``n`` consecutive words and fall into ``buckets`` hash buckets. Features are exploded
and counted by bucket, over the raw table and over the target table; a bucket's gain is the scaled logarithm of its smoothed share in the
target against its share in the raw table. The gain table has ``buckets`` rows, whatever the input, and is broadcast to the exploded features
again; a document's weight is the mean of its gains. Weight plus Gumbel noise, fixed by seed and id, orders the documents, so that the highest scores
are a draw without replacement by weight. The order is a distributed sort: rows are dealt by ranges of the order, and a
row's rank is its place in its partition plus the rows of all partitions before.

Counts go to at most ``buckets`` groups and are summed before they are shuffled; of a document only its id and two sums are shuffled, never its text.

Null texts have no words. Documents without words have weight 0. Rows that share an id are documents of their own, with the same noise;
a null id is written ``null`` and comes last among equal scores. An empty target gives every bucket the smoothed share of nothing, an empty raw table an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCORED = ["n_features", "weight", "score"]
_PLACE = (1 << 33) - 1  # monotonically_increasing_id has the place in the partition in its lower 33 bits


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and anything beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(common.lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def features(text: Column, n: int) -> Column:
    """All runs of 1 to n consecutive words, joined by one space."""
    own = words(text)
    if n == 1:
        return own

    def longer(w: Column, k: int) -> Column:
        joined = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) >= k, joined).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(own), lambda w: F.concat(w, *[longer(w, k) for k in range(2, n + 1)])))  # the words are split once


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(df: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all rows fall into each bucket; buckets without any are missing."""
    return df.select(F.explode(features(F.col(text), n)).alias("feature")).groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(raw: DataFrame, target: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain long), a row for each bucket: 1000 times the logarithm of the target's smoothed share over the raw table's, rounded down."""
    spark = raw.sparkSession
    own = bucket_counts(raw, text, n, buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, text, n, buckets).withColumnRenamed("n", "t")
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(own, "bucket", "left").join(wanted, "bucket", "left").na.fill(0, ["s", "t"])
    both = common.cut(both)  # read twice: for the totals and for the gains
    total = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = ((F.col("t").cast("double") + 1) * (F.col("all_s") + buckets)) / ((F.col("s").cast("double") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))  # one row of totals


def noise(id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def score(df: DataFrame, gain: DataFrame, id: str = "doc_id", text: str = "text", n: int = 1, buckets: int = 10_000, seed: int = 2024, row: str | None = None) -> DataFrame:
    """(id, n_features, weight, score), and the column ``row`` if given, of every row of df. ``gain`` has at most ``buckets`` rows."""
    keys = {"__id": F.col(f"`{id}`"), "__row": F.col(row) if row else F.monotonically_increasing_id()}
    numbered = df.select(*[v.alias(k) for k, v in keys.items()], F.col(f"`{text}`").alias("__text"))  # numbered before rows are exploded
    each = numbered.select(*keys, F.explode_outer(features(F.col("__text"), n)).alias("__feature")).withColumn("bucket", bucket(F.col("__feature"), buckets))
    own = each.join(F.broadcast(gain), "bucket", "left").groupBy(*keys).agg(F.count("__feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0).cast("long")).alias("__sum"))
    weight = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (__sum - pmod(__sum, n_features)) div n_features END")
    scored = own.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("__id"), seed))
    return scored.select(F.col("__id").alias(id), *SCORED, *([F.col("__row").alias(row)] if row else []))


def ranked(scored: DataFrame, id: str = "doc_id", percent: int = 10, min_features: int = 20) -> DataFrame:
    """scored with ``rank``: 1, 2, 3... by falling score, then id, over the highest ``percent`` of the rows with that many features; null for all others."""
    fit = F.col("n_features") >= min_features
    order = [(~fit).asc(), F.col("score").desc(), F.col(f"`{id}`").asc_nulls_last(), F.col("n_features").asc()]
    dealt = scored.repartitionByRange(common.parallelism(scored), *order).sortWithinPartitions(*order)
    placed = common.cut(dealt.withColumn("__at", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n"), F.count_if(fit).alias("__fit")).collect()  # a row a partition
    before, offsets, drawn = 0, [], percent * sum(p["__fit"] for p in parts) // 100
    for p in sorted(parts, key=lambda p: p["__part"]):
        offsets.append((p["__part"], before))
        before += p["__n"]
    offset = F.broadcast(scored.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit(_PLACE)) + 1
    joined = placed.withColumn("__part", F.shiftright("__at", 33)).join(offset, "__part")
    return joined.withColumn("rank", F.when(place <= drawn, place)).drop("__at", "__part", "__before")


def draw(df: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, min_features: int = 20, seed: int = 2024) -> DataFrame:
    """The rows of df that are drawn, all columns as they were. Names that begin with two underscores are reserved."""
    kept = common.cut(df.withColumn("__kept_row", F.monotonically_increasing_id()))  # row numbers are fixed once
    scores = score(kept, gains(df, target, text, n, buckets), id, text, n, buckets, seed, row="__kept_row")
    drawn = ranked(scores, id, percent, min_features).where("rank IS NOT NULL").select("__kept_row")
    return kept.join(drawn, "__kept_row", "left_semi").select(*[f"`{c}`" for c in df.columns])


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return ranked(score(docs, gains(docs, target))).select("doc_id", *SCORED, "rank")


QUERIES = {"op12_resampling": op12_resampling}
ORACLE = {
    "op12_resampling": """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bits(n, c) AS (SELECT n, c FROM (WITH RECURSIVE r(n, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
       UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM r WHERE k < 8) SELECT n, k, c FROM r) WHERE k = 8),
step AS (SELECT list(c ORDER BY n) AS t FROM bits),
vocabulary AS (SELECT DISTINCT word FROM (SELECT unnest(ws) AS word FROM w UNION ALL SELECT unnest(ws) FROM b)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: CAST(('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INT), 2)) AS BIGINT))),
       lambda c, x: xor(t[CAST(xor(c, x) & 255 AS INT) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM vocabulary, step),
doc_words AS (SELECT doc_id, bucket FROM (SELECT doc_id, unnest(ws) AS word FROM w) JOIN hashed USING (word)),
s AS (SELECT bucket, count(*) AS s FROM doc_words GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(ws) AS word FROM b) JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
gain AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000)) / ((s::DOUBLE + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), totals),
own AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM doc_words JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
       CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST(('0x' || substr(sha256('2024:' || doc_id), 1, 8)) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise FROM documents LEFT JOIN own USING (doc_id)),
placed AS (SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score FROM scored),
fit AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM placed WHERE n_features >= 20)
SELECT p.doc_id, p.n_features, p.weight, p.score, CASE WHEN f.place <= 10 * f.n // 100 THEN f.place END AS rank FROM placed p LEFT JOIN fit f USING (doc_id)"""
}
