"""Completion of names, explanations of entities, and filters of lists."""

from __future__ import annotations

import re
from itertools import permutations, product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def complete(terms: DataFrame, text: str, first: int = 10) -> DataFrame:
    """The first names that begin with the text, in alphabetical order; the shortest come first."""
    fact = text.replace(";", ".").split(".")[-1].strip().lower()
    if len(fact) < 2:
        return terms.where("false").select("term")
    return terms.where(F.startswith(F.lower("term"), F.lit(fact))).select("term").distinct().orderBy(F.lower("term"), "term").limit(first).orderBy(F.length("term"), "term")


def complete_variable(text: str, types: list[str]) -> list[str]:
    """``?x(Ty`` to ``?x(Type)`` for each type that begins so."""
    name, _, begin = text.partition("(")
    return [f"{name}({t})" for t in sorted(types) if t.lower().startswith(begin.lower())]


def without_plurals(terms: DataFrame, least: int = 5) -> DataFrame:
    """Names without those that only add an s to another of ``least`` letters or more."""
    single = terms.where(F.length("term") >= least).select(F.concat("term", F.lit("s")).alias("term"))
    return terms.join(single, "term", "left_anti")


def word_orders(name: str, most: int = 5) -> list[str]:
    """All orders of a name's words. Parts between And and Or are permuted each and change places; names that are long or hold For, Of or Off stay."""
    if re.search("For|Of", name):
        return [name]
    parts = re.split(" (And|Or) ", name)
    if len(parts) == 1:
        words = name.split(" ")
        return [name] if len(words) > most else sorted({" ".join(p) for p in permutations(words)})
    orders = [word_orders(p.strip(), most) for p in parts[::2]]
    out = set()
    for choice in product(*orders):
        for own in permutations(choice):
            out.add("".join(f"{p} {c} " for p, c in zip(own, [*parts[1::2], ""])).strip())
    return sorted(out)


def explanation(names: list[str], most: int) -> list[str]:
    """An entity's names in order, without those that another's words begin, cut at ``most`` with a count of the rest."""
    kept: list[str] = []
    for n in sorted({n for n in names if len(n) > 1}):
        if not any(n.split(" ")[: len(k.split(" "))] == k.split(" ") or n.replace(",", "").split(" ")[: len(k.split(" "))] == k.split(" ") for k in kept):
            kept.append(n)
    return kept if len(kept) <= most else [*kept[:most], f"and {len(kept) - most} more"]


def explanations(names: DataFrame, most: int = 25) -> DataFrame:
    """(entity_id, names, n) of entities' names (entity_id, name): in order, without those that begin with all words of one before them (case and punctuation do not
    count), at most ``most`` with a count of the rest. For all entities at once.

    A name is dropped by a name kept before it just if it is by any before it, since what drops that one drops both. So one look-up of each name's own
    beginnings among the first names with those words decides, without going through an entity's names in turn.
    """
    own = names.select("entity_id", F.btrim("name").alias("name")).where(F.length("name") > 1).distinct()
    words = F.array_remove(F.split(F.lower(F.regexp_replace("name", r"\p{Punct}", "")), " +"), "")
    own = own.withColumn("words", words).where(F.size("words") > 0)
    first = own.groupBy("entity_id", F.array_join("words", " ").alias("begin")).agg(F.min("name").alias("first"))
    begins = own.select("entity_id", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.array_join(F.slice("words", F.lit(1), n), " "))).alias("begin"))
    dropped = begins.join(first, ["entity_id", "begin"]).where("first < name").select("entity_id", "name").distinct()
    kept = own.select("entity_id", "name").join(dropped, ["entity_id", "name"], "left_anti").groupBy("entity_id").agg(F.sort_array(F.collect_list("name")).alias("all"))
    more = F.array(F.concat(F.lit("and "), (F.size("all") - most).cast("string"), F.lit(" more")))
    return kept.select("entity_id", F.when(F.size("all") > most, F.concat(F.slice("all", 1, most), more)).otherwise(F.col("all")).alias("names"), F.size("all").cast("long").alias("n"))


def listed(rows: DataFrame, name: str, text: str, order: str = "count") -> DataFrame:
    """Rows of a list by name: one letter is its first, more may be anywhere; ordered by count, name or phase."""
    low = F.lower(name)
    test = F.startswith(low, F.lit(text.lower())) if len(text) == 1 else F.contains(low, F.lit(text.lower()))
    by = {"count": [F.desc("n"), name], "name": [name], "phase": [F.desc("phase"), F.desc("n"), name]}[order]
    return rows.where(test).orderBy(*by)


def top_nodes(nodes: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent nodes of each type, of (node, type, n)."""
    order = Window.partitionBy("type").orderBy(F.desc("n"), "node")
    return nodes.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def visible_network(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges between nodes (node) that are shown."""
    return edges.join(shown.select(F.col("node").alias("source")), "source", "left_semi").join(shown.select(F.col("node").alias("target")), "target", "left_semi")
