"""A training-data pipeline over `documents`: each stage works on what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, langid, mixing, ngramjoin, tokens
from quillon.llm.shared import scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are null, hold no letter, or need more phrases a symbol than text of any learned language.

    Where no language was learned, or no labelled text is held out to judge by, all documents with a letter stay.
    """
    return langid.within(langid.identify(spark, docs), langid.limits(spark, docs)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones: that with the smallest doc_id, once. Null doc_ids stay."""
    return ngramjoin.keep_one(spark, docs, table(spark, ngramjoin.jaccard_components(spark, docs), "groups"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages beyond the contract's share."""
    found = decontaminate.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources so that token shares meet the tempered weights; each document stays."""
    return mixing.mix_sources(spark, docs).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents' tokens as wavelet matrices and returns what the files hold."""
    return tokens.documents_to_tokens(spark, docs, pieces=200_000, words=300_000)  # workers hold the stages before as well


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Suffix automata, bisection and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
