"""A corpus pipeline of five stages, from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept.  All but the last return the columns of ``docs``; the last returns where
each piece of each document lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontam, langid, packing, secrets, simhash, tokencounts
from factloom.llm._shared import forget, materialise, ship, table

#: The vocabulary that secrets are tested with and sequences are measured in.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is found with confidence; null, empty and wordless texts are in none.  Rows are judged each."""
    ship(spark)
    return langid.identify(docs, declared=F.col("lang"), host=F.col("source"), keep_columns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: fingerprints of 3-word shingles within three bits.

    Empty texts are copies of each other.  See README on what 3 bits leave.
    """
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly such passages go, null and empty ones stay."""
    ship(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; none goes."""
    ship(spark)
    return secrets.redact(docs, VOCABULARY)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences; documents without tokens lie nowhere, repeated ones each."""
    ship(spark)
    counted = tokencounts.token_counts(docs, VOCABULARY, keep=["doc_id"])
    # One more for the end of each text that has tokens.
    return packing.pack(counted.withColumn("n_tokens", F.when(F.col("n_tokens") > 0, F.col("n_tokens") + 1)))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Trigram models, fingerprints and byte-pair tokens are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
