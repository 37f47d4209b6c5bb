"""A training corpus from documents: five stages, each over all rows that the one before it kept.

Every stage takes an empty table (and returns one), equal rows and columns beside those of documents, which pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradelake.llm import decontam, jaccard, langid, mixing, sharding
from gradelake.llm.common import small_batches, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: null texts, texts without letters, and those far from every profile. A null doc_id is no reason to go."""
    small_batches(spark)
    return langid.in_known_language(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays, of rows equal in doc_id and text one. Rows without words or doc_id stay."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark, a twentieth of their words or more, go. Null and empty texts have no words and stay."""
    small_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut and repeated to their target weights; a document comes as often as it is taken. A null source is a source; rows without words follow their key like others."""
    return mixing.mix_documents(docs)


def sharding_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and its place there. Null ids and texts are hashed like others; a null text has no bytes."""
    return sharding.shard_table(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", sharding_rows),
]

#: SQL has no words for the learned profiles of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
