"""Tables of query strings to patterns: facts are cut at relation names, and their ends looked up in the tagger index, all as joins.

A string is one fact or several, between ``_AND_``. In a fact every place of a relation's name with words on both sides is a way to read it; the ends of all
ways are looked up together, once each, and the way whose ends are both known is taken: the longest relation, then the leftmost. An end is a variable (``?X``, ``?X(Type)``), the
name of a type, an id with its prefix, or a term: then it stands for all entities with a synonym that has, for every word of the term, a word that begins with it.

A term is joined to the index by the beginnings of words, on its longest word; the others are tested on what that finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUNCTUATION = r"\p{Punct}"
#: Prefixes of ids as they are written in queries, and the types of what they name.
ID_TYPES = {"mesh:": "MeSH", "gene:": "Gene", "species:": "Species", "fidx": "DosageForm", "chembl": "Drug"}
LEAST_LETTERS = 3
ENTITIES = "array<struct<id:string,type:string>>"


def word_starts(index: DataFrame) -> DataFrame:
    """(start, entity_id, entity_type, synonym, synonym_processed): every beginning of every word of the synonyms."""
    rows = index.select("entity_id", "entity_type", "synonym", "synonym_processed").distinct()
    words = F.explode(F.array_distinct(F.split(F.btrim("synonym_processed"), " "))).alias("word")
    each = rows.select("*", words)
    return each.select(*rows.columns, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), lambda n: F.substring("word", F.lit(1), n))).alias("start")).distinct()


def search_words(text: Column) -> Column:
    """Distinct lower-cased words, punctuation as spaces."""
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.lower(text), PUNCTUATION, " "), " +")), "")


def tagged(terms: DataFrame, starts: DataFrame) -> DataFrame:
    """(term, entities) of the terms that the index knows."""
    rows = terms.select("term", search_words(F.col("term")).alias("words")).where(F.length(F.array_join("words", "")) >= LEAST_LETTERS)
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    found = rows.withColumn("start", longest).join(starts, "start").where(F.forall("words", lambda w: F.contains(F.col("synonym_processed"), F.concat(F.lit(" "), w))))
    return found.groupBy("term").agg(F.sort_array(F.collect_set(F.struct(F.col("entity_id").alias("id"), F.col("entity_type").alias("type")))).alias("entities"))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _ends(ends: DataFrame, starts: DataFrame, types: dict[str, str]) -> DataFrame:
    """(end, entities, variable, reason) of ends (end). types: lower-cased names to types."""
    low = F.lower(F.replace("end", F.lit("_"), F.lit(" ")))
    name, kind = F.regexp_extract("end", r"(\?\w+)", 1), F.lower(F.regexp_extract("end", r"\((\w+/?\w+?)\)", 1))
    own = _lookup(types, kind)
    typed = F.when(kind == "", name).otherwise(F.concat(name, F.lit("("), own, F.lit(")")))
    bare = _lookup(types, low)
    prefix = F.coalesce(*[F.when(F.startswith(low, F.lit(p)), F.lit(p)) for p in ID_TYPES])
    whole = F.upper(F.col("end"))
    ident = F.when(prefix.isin("gene:", "species:"), F.substring_index("end", ":", -1)).otherwise(whole)
    variable = F.startswith(F.col("end"), F.lit("?"))
    read = ends.select(
        "end",
        F.when(variable, typed).when(prefix.isNull() & bare.isNotNull(), F.concat(F.lit("?"), bare, F.lit("("), bare, F.lit(")"))).alias("variable"),
        F.when(variable & (name == ""), "variable without a name").when(variable & (kind != "") & own.isNull(), "unknown type").alias("wrong"),
        F.when(~variable & prefix.isNotNull(), F.array(F.struct(ident.alias("id"), _lookup(ID_TYPES, prefix).alias("type")))).alias("given"),
    )
    terms = read.where("variable IS NULL AND wrong IS NULL AND given IS NULL").select(F.col("end").alias("term"))
    known = tagged(terms, starts).withColumnsRenamed({"term": "end", "entities": "found"})
    entities = F.coalesce("given", "found")
    reason = F.coalesce("wrong", F.when(F.col("variable").isNull() & entities.isNull(), "unknown term"))
    return read.join(known, "end", "left").select("end", F.when(reason.isNull(), entities).alias("entities"), F.when(reason.isNull(), F.col("variable")).alias("variable"), reason.alias("reason"))


def ways(parts: DataFrame, relations: list[str]) -> DataFrame:
    """Parts with relation, place, subject and object of each way to read them; null, where there is none."""
    tokens = F.split("part", " ")
    low = F.transform(tokens, F.lower)
    at = []
    for r in sorted(relations):
        names = r.lower().split(" ")
        n = len(names)
        fits = F.sequence(F.lit(2), F.greatest(F.size(tokens) - n, F.lit(2)))
        same = _same(low, names)
        own = F.transform(F.filter(fits, same), _way(r, n, tokens))
        at.append(F.when(F.size(tokens) >= n + 2, own).otherwise(F.array().cast("array<struct<relation:string,n:int,place:int,subject:string,object:string>>")))
    return parts.select("*", F.explode_outer(F.concat(*at)).alias("way")).select(*parts.columns, "way.*")


def _same(low: Column, names: list[str]):
    def test(i: Column) -> Column:
        out = F.lit(True)
        for k, name in enumerate(names):
            out &= F.get(low, i - 1 + k) == name
        return out

    return test


def _way(relation: str, n: int, tokens: Column):
    def way(i: Column) -> Column:
        return F.struct(
            F.lit(relation).alias("relation"), F.lit(n).alias("n"), i.alias("place"), F.array_join(F.slice(tokens, F.lit(1), i - 1), " ").alias("subject"), F.array_join(F.slice(tokens, i + n, F.size(tokens)), " ").alias("object")
        )

    return way


def translate(queries: DataFrame, key: list[str], index: DataFrame, relations: list[str], types: dict[str, str], text: str = "query") -> DataFrame:
    """(key, fact, subject, relation, object, reason) of each fact of each query string: sides are variables or entities as ``type:id``, in order, between bars.

    A fact that can't be read has a reason, and so has a string without any (its fact is 0). key identifies the strings.
    """
    clean = F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    parts = F.filter(F.transform(F.split(clean, "_AND_"), lambda p: F.btrim(F.replace(p, F.lit('"'), F.lit("")))), lambda p: p != "")
    each = queries.select(*key, F.posexplode_outer(parts).alias("fact", "part")).withColumn("fact", F.coalesce(F.col("fact") + 1, F.lit(0)).cast("long"))
    read = ways(each, relations)
    ends = read.select(F.explode(F.array("subject", "object")).alias("end")).where("end IS NOT NULL").distinct()
    known = _ends(ends, word_starts(index), {k.lower(): v for k, v in types.items()})
    none = read.where("relation IS NULL")  # without ends; all in one task if they were looked up
    read = read.where("relation IS NOT NULL")
    for side in ("subject", "object"):
        shown = F.coalesce("variable", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["id"])), "|"))
        read = read.join(known.select(F.col("end").alias(side), shown.alias(f"{side}_is"), F.col("reason").alias(f"{side}_reason")), side, "left")
    read = read.unionByName(none, allowMissingColumns=True)
    wrong = F.coalesce(F.concat(F.lit("subject: "), F.col("subject_reason")), F.concat(F.lit("object: "), F.col("object_reason")))
    reason = F.when(F.col("fact") == 0, "empty").when(F.col("relation").isNull(), "no relation").otherwise(wrong)
    read = read.withColumn("reason", reason)
    best = Window.partitionBy(*key, "fact").orderBy(F.col("reason").isNotNull(), F.desc("n"), "place")  # the ways to read one fact
    chosen = read.withColumn("r", F.row_number().over(best)).where("r = 1")
    good = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    return chosen.select(*key, "fact", good("subject_is").alias("subject"), good("relation").alias("relation"), good("object_is").alias("object"), "reason")


def answerable(translated: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_facts, reason): a string can be asked if all its facts can be read; else the reason of the first that can't."""
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("fact", "reason")))["reason"]
    return translated.groupBy(*key).agg(F.count_if(F.col("reason").isNull()).alias("n_facts"), first.alias("reason"))
