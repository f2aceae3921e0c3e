"""Schema support, keyword queries, trials, usage logs and content statistics."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stemming import porter

DOC = ["document_collection", "document_id"]
PHASES = {"NA": -1, "EARLY_PHASE1": 0, "PHASE1": 1, "PHASE2": 2, "PHASE3": 3, "PHASE4": 4}


def schema_support(predications: DataFrame) -> DataFrame:
    """Distinct documents of each (subject type, relation, object type)."""
    rows = predications.where("relation IS NOT NULL").select(*DOC, "subject_type", "relation", "object_type").distinct()
    return rows.groupBy("subject_type", "relation", "object_type").agg(F.count("*").alias("support"))


def type_cooccurrence(tags: DataFrame) -> DataFrame:
    """Distinct documents of each ordered pair of entity types, a type with itself included."""
    types = tags.groupBy(*DOC).agg(F.collect_set("ent_type").alias("types"))
    pairs = types.select(F.explode("types").alias("type_a"), "types").select("type_a", F.explode("types").alias("type_b"))
    return pairs.groupBy("type_a", "type_b").agg(F.count("*").alias("support"))


def best_types(tags: DataFrame, ids: DataFrame, preferred: str | None = None) -> DataFrame:
    """For each ambiguous entity id its type of most support; ties go to a preferred type, then by name."""
    s = tags.join(ids, "ent_id", "left_semi").select(*DOC, "ent_id", "ent_type").distinct().groupBy("ent_id", "ent_type").agg(F.count("*").alias("support"))
    w = Window.partitionBy("ent_id").orderBy(F.desc("support"), F.desc(F.col("ent_type") == F.lit(preferred)) if preferred else F.lit(0), "ent_type")
    return s.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def keyword_chains(schema: DataFrame, types: list[str], top: int | None = None) -> DataFrame:
    """Chains of relations that connect typed keywords in some order, with the support that they are ranked by; ``associated`` joins any two types, with 0.

    The support starts at the first edge that has any and is then the least so far, so an edge without support before the others does not count. Of chains
    that differ only in the direction of their edges the first order of keywords stays.
    """
    spark = schema.sparkSession
    orders = [(k, list(o), [types[i] for i in o]) for k, o in enumerate(permutations(range(len(types))))]  # at most 120 for five keywords
    pairs = sorted({(a, b) for _, _, t in orders for a, b in zip(t, t[1:])})
    known = schema.where(F.col("subject_type").isin(types) & F.col("object_type").isin(types))
    free = spark.createDataFrame(pairs, "subject_type string, object_type string").withColumn("relation", F.lit("associated"))
    relations = known.select("subject_type", "object_type", "relation", "support").unionByName(free.join(known, free.columns, "left_anti").withColumn("support", F.lit(0).cast("long")))
    rows = spark.createDataFrame(orders, "k int, o array<int>, t array<string>").withColumn("edges", F.array().cast("array<struct<a:int,b:int,r:string>>")).withColumn("relations", F.array().cast("array<string>")).withColumn("support", F.lit(0).cast("long"))
    for i in range(len(types) - 1):
        step = relations.select(F.col("subject_type").alias("__s"), F.col("object_type").alias("__o"), F.col("relation").alias("__r"), F.col("support").alias("__n"))
        rows = rows.join(F.broadcast(step), (F.col("t")[i] == F.col("__s")) & (F.col("t")[i + 1] == F.col("__o")))  # a few relations of each pair of types
        edge = F.struct(F.least(F.col("o")[i], F.col("o")[i + 1]).alias("a"), F.greatest(F.col("o")[i], F.col("o")[i + 1]).alias("b"), F.col("__r").alias("r"))
        support = F.when((F.col("support") == 0) & (F.col("__n") > 0), F.col("__n")).otherwise(F.least("support", "__n"))
        rows = rows.select("k", "o", "t", F.array_append("edges", edge).alias("edges"), F.array_append("relations", F.col("__r")).alias("relations"), support.alias("support"))
    first = F.min(F.struct("k", F.array_join("t", "-").alias("chain"), F.array_join("relations", ",").alias("relations"), "support")).alias("x")
    chains = rows.groupBy(F.array_sort("edges").alias("edges")).agg(first).select("x.chain", "x.relations", "x.support")
    return chains if top is None else chains.orderBy(F.desc("support"), "chain", "relations").limit(top)


def suggestions(chains: DataFrame, specific: int = 2) -> DataFrame:
    """The best specific chains and the best one that only associates."""
    only = F.forall(F.split("relations", ","), lambda r: r == "associated")
    order = [F.desc("support"), "chain", "relations"]
    return chains.where(~only).orderBy(*order).limit(specific).unionByName(chains.where(only).orderBy(*order).limit(1))


def trial_phases(trials: DataFrame, drugs: DataFrame, diseases: DataFrame) -> DataFrame:
    """(drug, disease, phase): the highest phase of trials (interventions, conditions, phases, values separated by bars) for tagged names."""
    phase = F.array_max(F.transform(F.split("phases", r"\|"), lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), F.upper(F.trim(p)))))
    rows = trials.select(F.explode(F.split("interventions", r"\|")).alias("i"), "conditions", phase.alias("phase")).select("i", F.explode(F.split("conditions", r"\|")).alias("c"), "phase")
    drug = drugs.select(F.lower("name").alias("__i"), F.col("entity_id").alias("drug"))
    disease = diseases.select(F.lower("name").alias("__c"), F.col("entity_id").alias("disease"))
    return rows.join(drug, F.lower(F.trim("i")) == F.col("__i")).join(disease, F.lower(F.trim("c")) == F.col("__c")).groupBy("drug", "disease").agg(F.max("phase").alias("phase"))


def with_phase(rows: DataFrame, phases: DataFrame, key: list[str]) -> DataFrame:
    """Rows with their trial phase, -1 if unknown."""
    return rows.join(phases, key, "left").withColumn("phase", F.coalesce("phase", F.lit(-1)))


def sampled_documents(tags: DataFrame, per_entity: int = 100, seed: int = 0) -> DataFrame:
    """(ent_id, ent_type, document) of at most per_entity documents of each entity, the same for the same seed. The sample is the feature: keywords are drawn from it."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), "document_collection", F.col("document_id").cast("string")))
    order = Window.partitionBy("ent_id", "ent_type").orderBy(drawn, "document_id")
    rows = tags.select(*DOC, "ent_id", "ent_type").distinct()
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_entity).drop("__n")


def stem(word):
    return porter(word)


def shortest_words(words: DataFrame) -> DataFrame:
    """(stem, word): the shortest word of each stem, the first in order of equals."""
    return words.groupBy(stem(F.col("word")).alias("stem")).agg(F.min(F.struct(F.length("word").alias("n"), F.col("word"))).alias("x")).select("stem", "x.word")


def merged_keywords(scored: DataFrame) -> DataFrame:
    """(entity_id, term, score) with the terms of one stem as one, named by the shortest, with the best (lowest) score."""
    own = scored.groupBy("entity_id", stem(F.col("term")).alias("stem")).agg(F.min(F.struct(F.length("term").alias("n"), F.col("term"))).alias("x"), F.min("score").alias("score"))
    return own.select("entity_id", "x.term", "score")


def frequent_terms(keywords: DataFrame, top: int = 200) -> DataFrame:
    """The most frequent keywords over all entities."""
    return keywords.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def keyword_weights(scored: DataFrame, keep: int = 20) -> DataFrame:
    """(entity_id, term, score) to weights 1..8 of the best terms of each entity."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("score"), "term")
    rows = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    own = Window.partitionBy("entity_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    # the best term of all gets 8: scores are turned round, since the scale falls as they grow
    return rows.select("entity_id", "term", (8 - F.floor(F.coalesce(F.try_divide(7 * (high - F.col("score")), high - low), F.lit(0)))).cast("int").alias("weight"))


def top_values(log: DataFrame, as_of: str, k: int = 5) -> DataFrame:
    """The most frequent query strings of today, this ISO week, month, year and ever."""
    d = F.lit(as_of).cast("date")
    within = {"today": F.col("log_date") == d, "week": (F.weekofyear("log_date") == F.weekofyear(d)) & (F.year("log_date") == F.year(d)), "month": F.trunc("log_date", "month") == F.trunc(d, "month"), "year": F.year("log_date") == F.year(d), "all": F.lit(True)}
    rows = log.select("query_string", F.explode(F.filter(F.array(*[F.when(c, F.lit(p)) for p, c in within.items()]), lambda p: p.isNotNull())).alias("period"))
    counts = rows.groupBy("period", "query_string").agg(F.count("*").alias("n"))
    w = Window.partitionBy("period").orderBy(F.desc("n"), "query_string")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def occurrence_counters(log: DataFrame, as_of: str) -> DataFrame:
    """How often today (t), this week (tw), this and last month (tm, lm), this and last year (ty, ly). Last month is the month before of the same year."""
    d = F.lit(as_of).cast("date")
    x = F.col("log_date")
    this = F.year(x) == F.year(d)
    week = this & (F.weekofyear(x) == F.weekofyear(d))
    tests = {"t": week & (x == d), "tw": week, "tm": this & (F.month(x) == F.month(d)), "lm": this & (F.month(x) == F.month(d) - 1), "ty": this, "ly": F.year(x) == F.year(d) - 1}
    return log.groupBy("query_string").agg(*[F.count(F.when(c, 1)).alias(f"n_{k}") for k, c in tests.items()])


def days_ago(log: DataFrame, as_of: str, within: int) -> DataFrame:
    ago = F.datediff(F.lit(as_of).cast("date"), "log_date").cast("long")
    return log.where(ago.between(0, within)).groupBy(ago.alias("days_ago")).agg(F.count("*").alias("n"))


def log_suggestions(log: DataFrame) -> DataFrame:
    return log.groupBy(F.lower(F.trim("query_string")).alias("suggestion")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suggestion")


def log_profile(log: DataFrame) -> DataFrame:
    """Queries of each year and the share of those with several patterns."""
    return log.groupBy(F.year("log_date").alias("year")).agg(F.count("*").alias("n"), F.avg(F.contains("query_string", F.lit("_AND_")).cast("int")).alias("share_of_several"))


def tags_of_types(tags: DataFrame, least: int) -> DataFrame:
    return tags.groupBy("ent_type").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"))


def statements_by(predications: DataFrame, *keys: str) -> DataFrame:
    """Statements by keys; those without a relation count nothing."""
    return predications.groupBy(*keys).agg(F.count("relation").alias("n"))
