"""Mixing sources to target weights by weighted fair queueing.

A document's cost is its number of words. Documents of a source are shuffled by MD5; a copy's virtual finish time is the
source's cumulative cost up to and with it, divided by the source's weight. A second pass over a source continues the first,
so its documents finish again later, and no document is taken more than ``max_epochs`` times. All copies are ordered by finish
time and taken until the budget is used up; the copy that crosses it is cut there. Since every active source advances in
proportion to its weight, what is taken is the water-filling target: min(max_epochs * size, weight * V) with one V for all.

Weights repeat over the sources in code-point order, null last. Null and empty texts cost nothing and are never taken; an
empty table gives an empty result. ``take`` replaces input columns named like an added one, ``repeat`` keeps all columns. Names that begin
with two underscores are reserved. Targets are worked out over one row a source, so only the number of sources bounds that step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, ranking

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
BUCKETS, MAX_BUCKETS, PER_BUCKET = 4096, 1 << 20, 50_000  # ranges of finish time: as many as give some PER_BUCKET copies each
BROADCAST_SOURCES = 100_000  # sources whose places in the queue are broadcast (some 100 bytes each); beyond that Spark chooses the join
ADDED = ["size", "source_size", "target", "taken"]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target): one row a source throughout."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    full = (F.lit(max_epochs) * F.col("source_size")).cast("long")
    w = sizes.withColumn("weight", weight.cast("long")).withColumn("__full", full)
    by_ratio = Window.orderBy(F.col("__full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__full").over(before), F.lit(0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = w.withColumn("__level", left / rest)
    level = level.withColumn("__v", F.max("__level").over(everything))
    return level.select("source", "source_size", "weight", F.least(F.col("__full").cast("double"), F.col("weight") * F.col("__v")).alias("target"))


def _queue(docs: DataFrame, id: str, weights: tuple, share: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(documents with their ``__key``, one row a source, every copy with ``__t``, the words that the mix takes of it; None if no copy costs anything)."""
    keyed = common.cut(docs.withColumn("__key", ranking.key_of(F.col(id), seed=seed)))
    sizes = common.cut(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs))
    n, total = keyed.agg(F.count("*"), F.sum("size")).first()
    budget = int(share * (total or 0))
    small = sizes.select(F.col("source").alias("__source"), "source_size", "weight", "target")
    # buckets of finish time are ranges of the global order; top is about where the budget is used up, ranges widen beyond it
    top = sizes.agg(F.max(F.col("target") / F.col("weight"))).first()[0] or 0.0
    if not top:
        return keyed, small, None
    buckets = min(MAX_BUCKETS, max(BUCKETS, n * max_epochs // PER_BUCKET))
    queued = ranking.running_sum(keyed, "size", "__key", [id, "size"], ranking.digits(n), "__before", ["source"])
    queued = queued.join(small, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    row = Window.partitionBy("__bucket").orderBy("__finish", F.col("source").asc_nulls_last(), "__epoch", "__key", id).rowsBetween(Window.unboundedPreceding, -1)
    copies = queued.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).where("size > 0")
    copies = copies.withColumn("__finish", (F.col("__epoch") * F.col("source_size") + F.col("__before") + F.col("size")) / F.col("weight"))
    copies = common.cut(copies.withColumn("__bucket", F.when(F.col("__finish") < top, F.floor(F.col("__finish") * buckets / top)).otherwise(buckets + F.floor(F.log2(F.col("__finish") / top) * (buckets // 4))).cast("int")))
    offsets = copies.groupBy("__bucket").agg(F.sum("size").alias("__sum")).select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    ranged = copies.withColumn("__own", F.coalesce(F.sum("size").over(row), F.lit(0))).join(F.broadcast(offsets), F.col("__bucket") == F.col("__b"))  # some 2 x MAX_BUCKETS rows of 20 bytes at most
    return keyed, small, ranged.withColumn("__t", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("__offset") - F.col("__own"))).cast("long"))


def take(docs: DataFrame, id: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """(id, source, size, ...) with source_size, target, taken and ``copies`` (how often the document begins in the mix)."""
    keyed, small, copies = _queue(docs.drop("source_size", "target", "taken", "copies"), id, weights, share, max_epochs, seed)
    columns = [c for c in keyed.columns if c != "__key"]
    out, zero = [*columns, "source_size", "target"], F.lit(0).cast("long")
    none = (keyed if copies is None else keyed.where("size = 0")).join(small, F.col("source").eqNullSafe(F.col("__source")))
    none = none.select(*out, zero.alias("taken"), zero.alias("copies"))
    if copies is None:
        return none
    mixed = copies.groupBy(*columns, "__key", "__before", "source_size", "target").agg(F.sum("__t").alias("taken"), F.count(F.when(F.col("__t") > 0, 1)).alias("copies"))
    return mixed.select(*out, "taken", "copies").unionByName(none)


def repeat(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """docs with each row as often as the mix begins it, from never to ``max_epochs`` times; columns as they were.

    Inside a source and an epoch the queue's order is that of (key, id, size), so the mix takes all rows up to some place there. Only these places,
    one for each source and epoch, are joined to the documents: texts are not shuffled. Rows alike in id, source and size go together.
    """
    slim = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    _, _, copies = _queue(slim, "id", weights, share, max_epochs, seed)
    if copies is None:
        return docs.where("false")
    last = copies.where("__t > 0").groupBy(F.col("source").alias("__source"), "__epoch").agg(F.max(F.struct("__key", "id", "size")).alias("__last"))
    places = common.cut(last.groupBy("__source").agg(F.collect_list("__last").alias("__places")))  # max_epochs places a source
    if places.count() <= BROADCAST_SOURCES:
        places = F.broadcast(places)
    own = F.struct(ranking.key_of(F.col(id), seed=seed).alias("__key"), F.col(id).alias("id"), words(F.col(text)).alias("size"))
    rows = docs.withColumn("__own", own).join(places, F.col(source).eqNullSafe(F.col("__source"))).where("__own.size > 0")
    times = F.size(F.filter("__places", lambda p: F.col("__own") <= p))
    return rows.withColumn("__n", F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    return take(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mixing": op9_mixing}
ORACLE = {
    "op9_mixing": """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level FROM w
  WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, weight, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM l),
q AS (SELECT d.*, source_size, weight, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e, CAST(e * source_size + upto AS DOUBLE) / weight AS finish FROM q, (VALUES (0), (1)) AS epochs(e)),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, e, k, doc_id ROWS UNBOUNDED PRECEDING) - size AS before,
  CAST(floor(1.5 * (SELECT sum(size) FROM d)) AS BIGINT) AS budget FROM c)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(size, budget - before))) AS BIGINT) AS taken
FROM g GROUP BY doc_id, size, source_size, target"""
}
