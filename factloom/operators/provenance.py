"""Why a document matches: the statements and sentences behind each pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded, shortened
from ..model import ANY, Query, Var, Vocabulary

DOC = ["document_collection", "document_id"]


def explain(predications: DataFrame, query: Query, v: Vocabulary, documents: DataFrame | None = None) -> DataFrame:
    """Statements of documents with the position of each pattern that they support; a mirrored pattern takes either side's entities on both.

    Variables must have been bound (``Query.bound``).
    """
    rows = predications if documents is None else predications.join(documents.select(*DOC).distinct(), DOC, "left_semi")
    tests = []
    for p in query.patterns:
        if any(isinstance(e, Var) for e in (*p.subjects, *p.objects)):
            raise ValueError("bind the variables first")
        s, o = sorted({e.id for e in p.subjects}), sorted({e.id for e in p.objects})
        if v.mirrored(p.relation):
            s = o = sorted({*s, *o})
        relations = v.relations(p.relation)
        of = F.lit(True) if p.relation == ANY or relations is None else F.col("relation").isin(relations)
        tests.append(F.coalesce(of & F.col("subject_id").isin(s) & F.col("object_id").isin(o), F.lit(False)))
    # all patterns are tested in one scan
    met = F.filter(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]), lambda i: i.isNotNull())
    return rows.where(reduce(Column.__or__, tests)).select("*", F.explode(met).alias("pattern"))


def by_ids(provenance: DataFrame, predications: DataFrame, sentences: DataFrame) -> DataFrame:
    """(pattern, predication_id) with the statements and their sentences, texts shortened."""
    return provenance.join(predications, "predication_id").join(sentences.select("sentence_id", shortened(F.col("text")).alias("sentence")), "sentence_id")


def merged(explained: DataFrame, key: list[str], order: list[str] = ("subject_id", "relation", "object_id")) -> DataFrame:
    """Explanations of one pattern and sentence as one, taken in order: a word joins those of its side unless what is there already holds it as a part; best confidence."""
    rows = explained.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, "subject_id", "relation", "object_id"])))).alias("__s"), F.max("confidence").alias("confidence"), F.count("*").alias("statements"))  # a sentence's statements

    def join(c):
        words = F.filter(F.transform("__s", lambda x: x[c]), lambda w: w.isNotNull())
        return F.aggregate(words, F.lit(None).cast("string"), lambda acc, w: F.when(acc.isNull(), w).when(F.contains(acc, w), acc).otherwise(F.concat(acc, F.lit("//"), w))).alias(c)

    return rows.select(*key, *[join(c) for c in ("subject_id", "relation", "object_id")], "confidence", "statements")


def shown(explanations: DataFrame) -> DataFrame:
    """Explanations as they are shown: by pattern, highest confidence first, to two decimals."""
    return explanations.orderBy("pattern", F.desc("confidence")).withColumn("confidence", rounded(F.col("confidence")))
