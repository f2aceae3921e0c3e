"""A dictionary of names for completion: sorted, dealt by ranges into files, front-coded in blocks, and found by the files' least and greatest names.

A block holds names that follow each other; each but the first keeps how many letters it shares with the name before and the rest. A completion needs the
names from the prefix on: the table of bounds, a row a file, tells which file that begins in, and the next is only read if a name short of the number wanted.
Files are bounded in number: what the driver samples, lists and holds does not grow with the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PER_FILE, PER_BLOCK = 200_000, 64
#: More files than this are not made; a file then holds more names, of which a look-up reads the blocks that may hold the prefix.
MOST_FILES = 64
ENTRIES = "array<struct<shared:int,rest:string>>"
BLOCKS = f"block long, n int, entries {ENTRIES}, part int"
BOUNDS = "part int, low string, high string, n long"


def _shared_letters(a: Column, b: Column) -> Column:
    """How many letters two names have in common at their beginning."""
    return F.size(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: (n > 0) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))))


def _coded(names: Column) -> Column:
    """Sorted names as entries."""

    def entry(name: Column, i: Column) -> Column:
        shared = F.when(i == 0, 0).otherwise(_shared_letters(name, F.get(names, i - 1)))
        return F.struct(shared.cast("int").alias("shared"), F.substring(name, shared + 1, F.length(name)).alias("rest"))

    return F.transform(names, entry)


def _names(entries: Column) -> Column:
    """Entries as names."""
    none = F.array().cast("array<string>")
    return F.aggregate(entries, none, lambda done, e: F.concat(done, F.array(F.concat(F.substring(F.coalesce(F.get(done, F.size(done) - 1), F.lit("")), F.lit(1), e["shared"]), e["rest"]))))


def write(terms: DataFrame, path: str, per_file: int = PER_FILE, per_block: int = PER_BLOCK) -> None:
    """Store the distinct names of (term), null and empty ones left out, in the order of their lower-cased form."""
    names = terms.select("term").where("term <> ''").distinct().withColumn("low", F.lower("term"))
    files = min(MOST_FILES, max(1, -(-names.count() // per_file)))
    dealt = names.repartitionByRange(files, "low", "term").sortWithinPartitions("low", "term").withColumn("at", F.monotonically_increasing_id())
    place = dealt.withColumn("part", F.shiftright("at", 33).cast("int")).withColumn("block", F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / per_block))
    blocks = place.groupBy("part", "block").agg(F.sort_array(F.collect_list(F.struct("low", "term"))).alias("x"))
    coded = blocks.select("block", F.size("x").alias("n"), _coded(F.col("x.term")).alias("entries"), F.col("x")[0]["low"].alias("low"), F.element_at("x", -1)["low"].alias("high"), "part")
    # a part is one file of blocks in order
    coded.repartition(files, "part").sortWithinPartitions("part", "block").write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks")
    stored = terms.sparkSession.read.schema(BLOCKS + ", low string, high string").parquet(f"{path}/blocks")
    stored.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


class Dictionary:
    """A stored dictionary; its bounds, a row a file, are held by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.blocks = spark.read.schema(BLOCKS + ", low string, high string").parquet(f"{path}/blocks")
        self.bounds = sorted(tuple(r) for r in spark.read.schema(BOUNDS).parquet(f"{path}/bounds").collect())

    def parts(self, prefix: str, first: int) -> list[int]:
        """The files that hold the first names with a prefix."""
        out, sure = [], 0
        for part, low, high, n in self.bounds:
            if high < prefix or (low > prefix and not low.startswith(prefix)):
                continue
            out.append(part)
            if low.startswith(prefix) and high.startswith(prefix):
                sure += n
            if sure >= first or not high.startswith(prefix) and high > prefix:
                break
        return out

    def terms(self, blocks: DataFrame | None = None) -> DataFrame:
        return (self.blocks if blocks is None else blocks).select(F.explode(_names(F.col("entries"))).alias("term"))

    def complete(self, text: str, first: int = 10) -> DataFrame:
        """The first names that begin with a text of two letters or more, in alphabetical order; the shortest come first."""
        prefix = text.replace(";", ".").split(".")[-1].strip().lower()
        parts = self.parts(prefix, first) if len(prefix) >= 2 else []
        near = self.blocks.where(F.col("part").isin(parts) if parts else F.lit(False)).where((F.col("high") >= prefix) & ((F.col("low") <= prefix) | F.startswith("low", F.lit(prefix))))
        found = self.terms(near).where(F.startswith(F.lower("term"), F.lit(prefix)))
        return found.orderBy(F.lower("term"), "term").limit(first).orderBy(F.length("term"), "term")
