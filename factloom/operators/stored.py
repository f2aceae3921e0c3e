"""Pattern queries answered from a stored index of statements instead of the statements themselves.

A posting list is cut into blocks of 2**15 document ids, and holds offsets in its block as 16-bit numbers, which Parquet packs into 15 bits or fewer. Every list is stored
twice, ordered by subject and by object; folders are by order, relation, slot (crc32 of the leading end) and collection, and within a folder rows
are sorted by that end and block. A pattern with a constant side reads the folders of its relations and of the constant's slots, and of these the row
groups that may hold it. Lists of several patterns are intersected block by block, each block a group of its own, before any document is touched.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Pattern, Query, Var, Vocabulary, rewrite
from . import matching

DOC = matching.DOC
BITS = 15
LISTS = "subject_id string, subject_type string, object_id string, object_type string, block long, offsets array<short>, n int, order string, relation string, slot int, document_collection string"
FOLDERS = ["order", "relation", "slot", "document_collection"]
SUBJECT, OBJECT = "subject", "object"


def lists(statements: DataFrame) -> DataFrame:
    """Posting lists of statements, in blocks: the offsets of the documents of each key and collection, ascending. Statements may be dealt by their ``block`` already."""
    if "block" not in statements.columns:
        statements = statements.withColumn("block", F.shiftright("document_id", BITS))
    offset = (F.col("document_id") - F.shiftleft("block", BITS)).cast("short")
    rows = statements.where("relation IS NOT NULL").groupBy("document_collection", *matching.FACT, "block").agg(F.sort_array(F.collect_set(offset)).alias("offsets"))
    return rows.withColumn("n", F.size("offsets"))


def write(statements: DataFrame, path: str, slots: int = 16) -> None:
    """Store the index. Lists are dealt once, before they are stored in both orders, by relation and collection; a frequent one is split among several tasks by size."""
    each = lists(statements).hint("rebalance", "relation", "document_collection").withColumn("order", F.explode(F.array(F.lit(SUBJECT), F.lit(OBJECT))))
    end = F.when(F.col("order") == SUBJECT, F.col("subject_id")).otherwise(F.col("object_id"))
    each = each.withColumn("slot", (F.crc32(end.cast("binary")) % slots).cast("int")).withColumn("end", end)
    order = [*FOLDERS, "end", "block"]
    each.sortWithinPartitions(*order).drop("end").write.mode("overwrite").partitionBy(*FOLDERS).parquet(f"{path}/lists")
    statements.sparkSession.createDataFrame([(slots, BITS)], "slots int, bits int").coalesce(1).write.mode("overwrite").json(f"{path}/layout")


class Index:
    """A stored index, opened once: its folders are listed when it is opened."""

    def __init__(self, spark: SparkSession, path: str):
        layout = spark.read.schema("slots int, bits int").json(f"{path}/layout").first()
        if layout is None or layout.bits != BITS:
            raise ValueError(f"no index of this layout in {path}")
        self.slots, self.rows = layout.slots, spark.read.schema(LISTS).parquet(f"{path}/lists")

    def _folders(self, order: str, endpoints: tuple) -> Column:
        """Folders that hold lists whose leading end is one of the endpoints."""
        fits = F.col("order") == order
        if endpoints and not isinstance(endpoints[0], Var):
            fits &= F.col("slot").isin(sorted({zlib.crc32(e.id.encode()) % self.slots for e in endpoints}))
        return fits

    def of(self, pattern: Pattern, v: Vocabulary, collections: list[str] | None = None) -> DataFrame:
        """The lists that match a pattern or what it expands to, each once."""
        relations = v.relations(pattern.relation)
        constant = [not isinstance(side[0], Var) for side in (pattern.subjects, pattern.objects)]
        ways = []
        for a, b in ((SUBJECT, OBJECT), (OBJECT, SUBJECT))[: 2 if v.mirrored(pattern.relation) else 1]:
            lead, ends = (a, pattern.subjects) if constant[0] or not constant[1] else (b, pattern.objects)
            ways.append((lead, self._folders(lead, ends) & matching._side(pattern.subjects, a, v) & matching._side(pattern.objects, b, v)))
        rows = self.rows.where(F.lit(True) if relations is None else F.col("relation").isin(relations))
        if collections is not None:
            rows = rows.where(F.col("document_collection").isin(collections))
        parts = [rows.where(fits).drop("order", "slot") for _, fits in ways]
        # a list may fit both ways round, and is then read in both orders
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def answer(self, query: Query, vocabulary: Vocabulary, min_shared: int = 2, latest: int | None = None, term_index: DataFrame | None = None, tag_index: DataFrame | None = None, joint: bool = False, collections: list[str] | None = None) -> DataFrame:
        """What matching.match() gives over the statements that are stored."""
        planned = rewrite(query, vocabulary)
        options = {"min_shared": min_shared, "latest": latest, "term_index": term_index, "tag_index": tag_index, "joint": joint}
        if planned is None or not planned.patterns:
            return matching.match(self.rows.select(*DOC[:1], F.lit(None).cast("long").alias(DOC[1]), *matching.FACT), query, vocabulary, **options)
        found = [self.of(p, vocabulary, collections) for p in planned.patterns]
        sides = matching._sides(planned.patterns)
        if not sides:
            return matching.filters(documents(common(found)), planned, vocabulary, term_index, tag_index)
        rows = reduce(DataFrame.unionByName, found)
        # what a shared variable stands for is counted over the documents of its own patterns, so those of other patterns must not restrict it
        counted = min_shared > 1 and any(1 < len(where) < len(found) for where in sides.values())
        if len(found) > 1 and not counted:
            both = common(found).withColumnRenamed("offsets", "common")
            rows = rows.join(both, ["document_collection", "block"]).withColumn("offsets", F.array_intersect("offsets", "common")).where(F.size("offsets") > 0).drop("common")
        facts = documents(rows, *matching.FACT)
        return matching.match(facts, query, vocabulary, **options)


def common(found: list[DataFrame]) -> DataFrame:
    """(document_collection, block, offsets): documents with a list of each pattern, block by block. A group holds one block's lists."""
    rows = reduce(DataFrame.unionByName, [f.select("document_collection", "block", F.lit(i).alias("p"), "offsets") for i, f in enumerate(found)])
    own = [F.array_distinct(F.flatten(F.collect_list(F.when(F.col("p") == i, F.col("offsets"))))) for i in range(len(found))]
    blocks = rows.groupBy("document_collection", "block").agg(reduce(F.array_intersect, own).alias("offsets"))
    return blocks.where(F.size("offsets") > 0)


def documents(rows: DataFrame, *columns: str) -> DataFrame:
    """Lists as documents."""
    return rows.select("document_collection", "block", *columns, F.explode("offsets").alias("offset")).select("document_collection", (F.shiftleft("block", BITS) + F.col("offset")).alias("document_id"), *columns)


def touched(index: Index, query: Query, vocabulary: Vocabulary) -> DataFrame:
    """(pattern, lists, blocks, postings): how much of the index each pattern of a query reads."""
    planned = rewrite(query, vocabulary)
    parts = [index.of(p, vocabulary).select(F.lit(i).alias("pattern"), "document_collection", "block", "n") for i, p in enumerate(planned.patterns if planned else ())]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("pattern").agg(F.count("*").alias("lists"), F.count_distinct("document_collection", "block").alias("blocks"), F.sum("n").alias("postings"))
