"""Graph-pattern matching over exploded facts (one row for each statement key and document)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Entity, Pattern, Query, Var, Vocabulary, rewrite

DOC = ["document_collection", "document_id"]


FACT = ["subject_id", "subject_type", "relation", "object_id", "object_type"]


def statements(predications: DataFrame) -> DataFrame:
    """Queryable statements, those with a relation; match() takes each once a document itself."""
    return predications.where(F.col("relation").isNotNull()).select(*DOC, *FACT)


def facts(predications: DataFrame) -> DataFrame:
    """Queryable statements, once a document."""
    return statements(predications).distinct()


def _side(endpoints: tuple, side: str, v: Vocabulary) -> Column:
    """Ids and types of the endpoints are tested independently of each other."""
    if isinstance(endpoints[0], Var):
        t = endpoints[0].type
        return F.lit(True) if t is None else F.col(f"{side}_type").isin(v.types(t))
    ids, types = sorted({e.id for e in endpoints}), sorted({t for e in endpoints for t in v.types(e.type)})
    return F.col(f"{side}_id").isin(ids) & F.col(f"{side}_type").isin(types)


def _names(endpoints: tuple) -> str | None:
    """The output name of a side: its variable, or the class that all its entities share."""
    if isinstance(endpoints[0], Var):
        return endpoints[0].name
    classes = {e.cls for e in endpoints}
    return classes.pop() if len(classes) == 1 and len({e.type for e in endpoints}) == 1 and None not in classes else None


def hits(facts_: DataFrame, patterns: tuple, v: Vocabulary) -> DataFrame:
    """(document_collection, document_id, hits): for each document the set of (p, s_id, s_type, o_id, o_type), its statements that match pattern p or
    what that expands to, as the pattern's sides see them. All patterns are tested in one scan, and one shuffle brings a document's hits together.
    """
    ways = []
    for i, p in enumerate(patterns):
        relations = v.relations(p.relation)
        of = F.lit(True) if relations is None else F.col("relation").isin(relations)
        for a, b in (("subject", "object"), ("object", "subject"))[: 2 if v.mirrored(p.relation) else 1]:
            fits = of & _side(p.subjects, a, v) & _side(p.objects, b, v)
            ways.append((fits, F.struct(F.lit(i).alias("p"), *[F.col(f"{side}_{k}").alias(f"{n}_{k}") for side, n in ((a, "s"), (b, "o")) for k in ("id", "type")])))
    rows = facts_.where(reduce(Column.__or__, [c for c, _ in ways]))
    each = F.explode(F.filter(F.array(*[F.when(c, h) for c, h in ways]), lambda h: h.isNotNull()))
    return rows.select(*DOC, each.alias("hit")).groupBy(*DOC).agg(F.collect_set("hit").alias("hits"))


def _sides(patterns: tuple) -> dict[str, dict[int, list[str]]]:
    """Name of a variable to the patterns it stands in, and on which sides."""
    out: dict[str, dict[int, list[str]]] = {}
    for i, p in enumerate(patterns):
        for endpoints, side in ((p.subjects, "s"), (p.objects, "o")):
            if name := _names(endpoints):
                out.setdefault(name, {}).setdefault(i, []).append(side)
    return out


def _of(i: int):
    """A test whether a hit is of pattern i."""
    return lambda h: h["p"] == i


def _end(side: str):
    return lambda h: F.struct(h[f"{side}_id"].alias("id"), h[f"{side}_type"].alias("type"))


def _together(i: int, a: str, b: str):
    """A test whether a hit of pattern i holds what both variables stand for."""
    return lambda h: (h["p"] == i) & (h["s_id"] == F.col(a)["id"]) & (h["s_type"] == F.col(a)["type"]) & (h["o_id"] == F.col(b)["id"]) & (h["o_type"] == F.col(b)["type"])


def _bound(i: int, sides: list[str]) -> Column:
    """The entities that a variable stands for in a document by pattern i; on both sides it gets both sides' entities."""
    own = F.filter("hits", _of(i))
    return F.array_distinct(F.flatten(F.array(*[F.transform(own, _end(s)) for s in sides])))


def _shared(found: DataFrame, in_patterns: dict[int, list[str]], min_shared: int) -> DataFrame:
    """(document, ent): what a variable of several patterns stands for. Pattern by pattern, an entity stays in a collection only if min_shared documents share it."""
    (first, *rest) = in_patterns.items()
    rows = found.select(*DOC, F.explode(_bound(*first)).alias("ent"), *[_bound(i, s).alias(f"in_{i}") for i, s in rest])
    for i, _ in rest:
        rows = rows.where(F.array_contains(f"in_{i}", F.col("ent"))).drop(f"in_{i}")
        if min_shared > 1:
            enough = rows.groupBy("document_collection", "ent").count().where(F.col("count") >= min_shared).select("document_collection", "ent")
            rows = rows.join(enough, ["document_collection", "ent"], "left_semi")
    return rows.select(*DOC, "ent")


def match(facts_: DataFrame, query: Query, vocabulary: Vocabulary, min_shared: int = 2, latest: int | None = None, term_index: DataFrame | None = None, tag_index: DataFrame | None = None, joint: bool = False) -> DataFrame:
    """(document_collection, document_id, <variable>_id, <variable>_type ...): documents that match all patterns, once for each combination of bindings.

    facts_ may repeat statements. A variable of several patterns keeps an entity of a collection only if ``min_shared`` documents share it, pattern by
    pattern. Variables of one pattern combine freely in a document unless ``joint``. With variables, ``latest`` keeps that many of the latest documents of a
    collection.
    """
    planned = rewrite(query, vocabulary)
    names = query.variables()
    if planned is None:
        return facts_.select(*DOC, *[F.lit(None).cast("string").alias(f"{n}_{k}") for n in names for k in ("id", "type")]).where("false")
    if not planned.patterns:
        return filters(None, planned, vocabulary, term_index, tag_index)
    found = hits(facts_, planned.patterns, vocabulary)
    docs = found.where(reduce(Column.__and__, [F.exists("hits", _of(i)) for i in range(len(planned.patterns))]))
    bound = _sides(planned.patterns)
    docs = filters(docs if bound else docs.select(*DOC), planned, vocabulary, term_index, tag_index)
    if not bound:
        return docs
    if latest is not None:
        docs = latest_documents(docs, latest)
    out = [F.col(f"{n}.{k}").alias(f"{n}_{k}") for n in bound for k in ("id", "type")]
    pairs = [(i, a, b) for i, p in enumerate(planned.patterns) if (a := _names(p.subjects)) and (b := _names(p.objects)) and a != b] if joint else []
    for n, where in bound.items():
        if len(where) > 1:
            docs = docs.join(_shared(found, where, min_shared).withColumnRenamed("ent", n), DOC)
    for n, where in bound.items():
        if len(where) == 1:  # a document's own bindings need no join
            docs = docs.withColumn(n, F.explode(_bound(*next(iter(where.items())))))
    for i, a, b in pairs:
        docs = docs.where(F.exists("hits", _together(i, a, b)))
    return docs.select(*DOC, *out)


def _passing(index: DataFrame, tests: list[Column]) -> DataFrame:
    """Documents with a row for each test, found in one scan."""
    each = [F.max(t).alias(f"t{i}") for i, t in enumerate(tests)]
    return index.where(reduce(Column.__or__, tests)).groupBy(*DOC).agg(*each).where(reduce(Column.__and__, [F.col(f"t{i}") for i in range(len(tests))])).select(*DOC)


def filters(docs: DataFrame | None, query: Query, v: Vocabulary, term_index: DataFrame | None, tag_index: DataFrame | None) -> DataFrame:
    """Documents that also hold every term and an entity of every set; without patterns, all such documents."""
    terms = [F.col("term") == t.lower() for t in query.terms]
    sets = [reduce(Column.__or__, [F.col("ent_type").isin(v.types(e.type)) if isinstance(e, Var) else (F.col("ent_id") == e.id) & F.col("ent_type").isin(v.types(e.type)) for e in entities]) for entities in query.entity_sets]
    for index, tests in ((term_index, terms), (tag_index, sets)):
        if tests:
            own = _passing(index, tests)
            docs = own if docs is None else docs.join(own, DOC, "left_semi")
    if docs is None:
        raise ValueError("a query needs a pattern, a term or an entity")
    return docs


def latest_documents(docs: DataFrame, n: int, block: int = 1 << 16) -> DataFrame:
    """The n highest document ids of each collection. Counts by blocks of ids tell where the n end; only documents of the blocks that are needed are ranked."""
    docs = docs.withColumn("__block", F.floor(F.col("document_id") / block))
    later = Window.partitionBy("document_collection").orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    counts = docs.groupBy("document_collection", "__block").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(later), F.lit(0)))
    needed = counts.where(F.col("before") < n).select("document_collection", "__block", "before")
    order = Window.partitionBy("document_collection", "__block").orderBy(F.desc("document_id"))
    return docs.join(needed, ["document_collection", "__block"]).withColumn("__n", F.row_number().over(order) + F.col("before")).where(F.col("__n") <= n).drop("__n", "__block", "before")


def newest_answers(answer: DataFrame) -> DataFrame:
    """Answers in the order in which they are shown: highest document id first."""
    return answer.orderBy(F.desc("document_id"), "document_collection", *[c for c in answer.columns if c not in DOC])


def with_metadata(answer: DataFrame, metadata: DataFrame) -> DataFrame:
    """Answers whose documents have metadata; titles are cut to 500 characters."""
    return answer.join(metadata, DOC).withColumn("title", F.substring("title", 1, 500))


def substitution_counts(answer: DataFrame, variable: str, top: int | None = None) -> DataFrame:
    """How many answers each entity of a variable has, most first."""
    counts = answer.groupBy(f"{variable}_id", f"{variable}_type").agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), f"{variable}_id", f"{variable}_type").limit(top)


def entities(facts_: DataFrame) -> DataFrame:
    """All entities of the facts, which may repeat. Both ends of a fact come from one scan."""
    ends = F.array(*[F.struct(F.col(f"{side}_id").alias("ent_id"), F.col(f"{side}_type").alias("ent_type")) for side in ("subject", "object")])
    return facts_.select("subject_id", "subject_type", "object_id", "object_type").distinct().select(F.inline(ends)).distinct()


def known_collections(requested: list[str], configured: list[str]) -> list[str]:
    """The requested collections, if all are configured."""
    if unknown := sorted(set(requested) - set(configured)):
        raise ValueError(f"unknown collections: {', '.join(unknown)}")
    return requested


__all__ = ["Entity", "Pattern", "Query", "Var", "Vocabulary"]
