"""A training corpus from documents: toxic documents go, copies go, near copies go, sources are mixed, texts are encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but the last
return the columns of documents. Rows that share a doc_id are kept or dropped each by its own text, except that near copies are
decided by doc_id. Null texts count as empty; empty texts are neither toxic nor near copies, and are no part of a mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import byte_bpe, common, exact_dedup, mixing, ngram_join, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; the model is fitted on this stage's documents and the labels table."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exact_dedup.distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents whose sets of five-word shingles have a similarity of 0.8 or more."""
    return ngram_join.representatives(docs, ngram_join.Rule(words=5, num=80, den=100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix begins it, from not at all to twice."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the bytes that they decode to."""
    return byte_bpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's input goes when its output is written.

    What the last stage reads stays as long as its result may be asked for: the caller removes that folder.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder, before = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}_{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                common.remove(spark, before)
            before = path
    return docs
