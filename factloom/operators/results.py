"""Filters, groups and pages of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_condition
from . import ranks, topk


def by_title(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(title_condition(text, F.col("title")))


def by_year(rows: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Either bound may be open (None or 0)."""
    if first:
        rows = rows.where(F.col("publication_year") >= first)
    return rows.where(F.col("publication_year") <= last) if last else rows


def year_histogram(rows: DataFrame) -> DataFrame:
    """(year, n) from the first to the last year, gaps with 0; years up to 0 do not count."""
    counts = rows.where("publication_year > 0").groupBy(F.col("publication_year").alias("year")).agg(F.count("*").alias("n"))
    years = counts.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("year"))
    return years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_classes(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows whose classifications hold all wanted ones; none wanted: all rows."""
    if not wanted:
        return rows
    return rows.where(F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("classifications", F.array().cast("array<string>")))) == 0)


def main_view(rows: DataFrame, title: str = "", classes: list[str] = (), first: int | None = None, last: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, histogram) of a search: title, then classes, then the histogram is taken, then years."""
    rows = by_classes(by_title(rows, title), list(classes))
    return by_year(rows, first, last), year_histogram(rows)


def recommendation_view(rows: DataFrame, title: str = "", classes: list[str] = (), first: int | None = None, last: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, histogram) of recommendations: the histogram is taken first, then years, title and classes."""
    return by_classes(by_title(by_year(rows, first, last), title), list(classes)), year_histogram(rows)


def tree_level(answer: DataFrame, variables: list[str]) -> DataFrame:
    """Sizes of the groups at one level of the substitution tree: the entities of the first variables."""
    return answer.groupBy(*[f"{v}_{k}" for v in variables for k in ("id", "type")]).agg(F.count("*").alias("n"), F.countDistinct("document_collection", "document_id").alias("n_documents"))


def flat_groups(answer: DataFrame, variables: list[str]) -> DataFrame:
    """Groups by the set of substituted entities, whatever variables they stand for."""
    key = F.array_join(F.sort_array(F.array_distinct(F.array(*[F.concat_ws(":", f"{v}_type", f"{v}_id") for v in variables]))), ";")
    return answer.groupBy(key.alias("entities")).agg(F.count("*").alias("n"))


def page(groups: DataFrame, start: int, end: int, order: list) -> DataFrame:
    """Groups start..end-1, in order."""
    return groups.orderBy(*order).offset(start).limit(end - start)


def newest_first(rows: DataFrame, per: list[str], keep: int) -> DataFrame:
    """The newest documents of each group: by year, month and id."""
    w = Window.partitionBy(*per).orderBy(F.desc("publication_year"), F.desc("publication_month"), F.desc("document_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def single_variable(query) -> str:
    """The one variable that an ontology grouping needs; more are refused."""
    names = query.variables()
    if len(names) != 1:
        raise ValueError(f"an ontology grouping needs one variable, not {len(names)}")
    return names[0]


def ontology_counts(answer: DataFrame, variable: str, ontology: DataFrame, roots: dict[str, list[str]] | None = None) -> DataFrame:
    """(node, parent, n) for every tree number and all its prefixes; a document under several numbers counts at each.

    roots: for each entity type the beginnings of the tree numbers that it is shown under; other numbers and types are left out.
    """
    parts = F.split("tree_no", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    rows = answer.join(ontology.select(F.col("descriptor_id").alias(f"{variable}_id"), "tree_no"), f"{variable}_id")
    if roots is not None:
        shown = F.lit(False)
        for kind, begins in roots.items():
            for r in begins:
                shown |= (F.col(f"{variable}_type") == kind) & F.startswith("tree_no", F.lit(r))
        rows = rows.where(shown)
    rows = rows.select(F.explode(prefixes).alias("node"))
    return rows.groupBy("node").agg(F.count("*").alias("n")).withColumn("parent", F.when(F.contains("node", F.lit(".")), F.regexp_replace("node", r"\.[^.]*$", "")))


def sorted_groups(rows: DataFrame, levels: list[str]) -> DataFrame:
    """rows (levels, document_id, publication_year, publication_month) with a rank for each level, largest groups first (then by name), and ``document_rank``, newest first.

    Groups are ranked among the rows of their sizes, documents by a distributed sort, so no group meets in one task."""
    for i, level in enumerate(levels):
        sizes = rows.groupBy(*levels[: i + 1]).agg(F.count("*").alias("__n"))
        rows = rows.join(ranks.ranked(sizes, levels[:i], [F.desc("__n"), F.asc(level)], f"{level}_rank").drop("__n"), levels[: i + 1])
    return ranks.ranked(rows, levels, [F.desc("publication_year"), F.desc("publication_month"), F.desc("document_id")], "document_rank")


def outside_ontology(answer: DataFrame, variable: str, ontology: DataFrame) -> DataFrame:
    """Groups of bindings that no tree number covers, by type."""
    rest = answer.join(ontology.select(F.col("descriptor_id").alias(f"{variable}_id")), f"{variable}_id", "left_anti")
    return rest.groupBy(F.concat(f"{variable}_type", F.lit(" (no taxonomy)")).alias("label"), f"{variable}_id").agg(F.count("*").alias("n"))


def compress(counts: dict[str, int], own: set[str]) -> dict[str, str]:
    """Path compression of a collected tree of counts: a node without documents of its own and with one child is shown as that child."""
    children: dict[str, list[str]] = {}
    for node in counts:
        if "." in node:
            children.setdefault(node.rpartition(".")[0], []).append(node)
    shown = {}
    for node in sorted(counts, key=lambda n: -n.count(".")):
        only = children.get(node, [])
        shown[node] = shown[only[0]] if node not in own and len(only) == 1 else node
    return shown


def compressed_paths(nodes: DataFrame) -> DataFrame:
    """(node, shown) of a tree's nodes (node, own): a node without documents of its own (own) and with one child is shown as that child is.

    Nodes are dotted numbers, whose parents are given by the number. Chains are contracted by pointer jumping: each round every node points as far again, so a
    chain of n nodes takes log2(n) rounds of a join by node.
    """
    parent = F.when(F.instr("node", ".") > 0, F.regexp_replace("node", r"\.[^.]*$", ""))
    children = nodes.select(parent.alias("node"), F.col("node").alias("child")).where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("child").alias("child"))
    passed = ~F.col("own") & (F.coalesce("n", F.lit(0)) == 1)
    pointers = topk.cut(nodes.join(children, "node", "left").select("node", F.when(passed, F.col("child")).otherwise(F.col("node")).alias("shown")))
    depth = nodes.agg(F.max(F.size(F.split("node", r"\.")))).first()[0] or 1
    for _ in range((depth - 1).bit_length()):
        far = pointers.select(F.col("node").alias("shown"), F.col("shown").alias("far"))
        pointers = topk.cut(pointers.join(far, "shown").select("node", F.col("far").alias("shown")))
    return pointers


def overview(facts_: DataFrame, concept: str, other_types: list[str]) -> DataFrame:
    """All panels of a concept in one pass: documents for each relation and entity on the other side."""
    way = lambda a, b: facts_.where(F.col(f"{a}_id") == concept).select("document_collection", "document_id", "relation", F.col(f"{b}_id").alias("other_id"), F.col(f"{b}_type").alias("other_type"))
    rows = way("subject", "object").unionByName(way("object", "subject")).where(F.col("other_type").isin(other_types)).distinct()
    return rows.groupBy("relation", "other_type", "other_id").agg(F.count("*").alias("n"))


def minus_indications(panels: DataFrame, effect: str = "induces", indication: str = "treats") -> DataFrame:
    """Effects whose entity is not at least as often an indication."""
    a = panels.where(F.col("relation") == effect).select("other_id", "n")
    b = panels.where(F.col("relation") == indication).select("other_id", F.col("n").alias("m"))
    return a.join(b, "other_id", "left").where("m IS NULL OR m < n").select("other_id", "n")
