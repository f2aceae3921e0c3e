"""Substring search through postings of letter groups instead of a scan.

Every text's distinct groups of three letters are posted, shorter texts as they are. A needle's rows are those that have all of its groups, found by its rarest group
and tested on the others; what is left is verified. A needle of one or two letters takes the groups that hold it. Groups lie in folders by a hash of the group, so that
a search reads the folders of its groups.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Q = 3


def grams(text: Column, q: int = Q) -> Column:
    """Distinct groups of q letters of a lower-cased text; a shorter text is its only group."""
    low = F.lower(F.coalesce(text, F.lit("")))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (q - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(q)))
    return F.array_distinct(each)


def postings(texts: DataFrame, id: str, text: str, slots: int) -> DataFrame:
    rows = texts.select(F.col(id).alias("id"), F.explode(grams(F.col(text))).alias("gram")).where("gram <> ''").distinct()
    return rows.withColumn("slot", (F.crc32(F.col("gram").cast("binary")) % slots).cast("int"))


def write(texts: DataFrame, id: str, text: str, path: str, slots: int = 16) -> None:
    """Store the postings of (id, text), by slot, sorted by group."""
    rows = postings(texts, id, text, slots)
    rows.repartitionByRange("slot", "gram", "id").sortWithinPartitions("slot", "gram", "id").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/postings")
    texts.sparkSession.createDataFrame([(slots,)], "slots int").coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    rows.groupBy("slot", "gram").agg(F.count("*").alias("n")).repartitionByRange("slot", "gram").sortWithinPartitions("slot", "gram").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/counts")


class Search:
    def __init__(self, spark: SparkSession, path: str):
        self.postings, self.counts = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "counts"))  # tables without rows have no folders and can't be opened
        self.slots = spark.read.schema("slots int").json(f"{path}/layout").first()[0]

    def candidates(self, needles: DataFrame) -> DataFrame:
        """(needle, id) of rows that have all groups of a needle (needle, in any case); may hold some that lack the needle itself."""
        each = needles.select("needle").where("needle <> ''").distinct()
        long = each.where(F.length("needle") >= Q).withColumn("gs", grams(F.col("needle")))
        wanted = long.select("needle", F.size("gs").alias("k"), F.explode("gs").alias("gram"))
        counted = wanted.join(self.counts.select("gram", "n"), "gram")
        # a needle with a group that nobody has is found nowhere; the rarest group gives the rows, the others test them
        rare = counted.groupBy("needle", "k").agg(F.count("*").alias("known"), F.min(F.struct("n", "gram"))["gram"].alias("gram")).where("known = k").select("needle", "gram")
        first = rare.join(self.postings.select("gram", "id"), "gram").select("needle", "id", F.col("gram").alias("rarest"))
        others = first.join(wanted.select("needle", "gram", "k"), "needle").where("gram <> rarest")
        held = others.join(self.postings.select("gram", "id"), ["gram", "id"], "left_semi").groupBy("needle", "id").agg(F.count("*").alias("held"))
        full = first.join(long.select("needle", F.size("gs").alias("k")), "needle").join(held, ["needle", "id"], "left").where(F.coalesce("held", F.lit(0)) == F.col("k") - 1).select("needle", "id")
        short = each.where(F.length("needle") < Q)
        holding = self.counts.select("gram").join(F.broadcast(short), F.contains("gram", F.lower("needle")))  # at most all one- and two-letter needles
        return full.unionByName(holding.join(self.postings.select("gram", "id"), "gram").select("needle", "id").distinct())

    def find(self, needles: DataFrame, texts: DataFrame, id: str, text: str) -> DataFrame:
        """(needle, id) of the texts that hold a needle, in any case."""
        rows = self.candidates(needles).join(texts.select(F.col(id).alias("id"), F.lower(text).alias("text")), "id")
        return rows.where(F.contains("text", F.lower("needle"))).select("needle", "id")

    def one(self, needle: str) -> DataFrame:
        """(id) of candidates of a single needle, read from the folders of its groups alone."""
        low = needle.lower()
        own = sorted({low[i : i + Q] for i in range(len(low) - Q + 1)})
        if not own:
            raise ValueError(f"a needle of {Q} letters or more is asked for")
        slots = sorted({zlib.crc32(g.encode()) % self.slots for g in own})
        rows = self.postings.where(F.col("slot").isin(slots) & F.col("gram").isin(own))
        return rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(own)).select("id")
