"""A training corpus in five stages: language, near copies, secrets, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder and reads again as
the next stage's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import lang_id, minhash, mixing, packing, secret_scan
from lodestone.llm.queries import tokenizer_file
from lodestone.llm.shared import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; a null lang is filled with the predicted one, and a lang that the text contradicts is corrected."""
    return lang_id.keep_identified(docs, lang_id.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return minhash.deduplicate(docs, shingle_words=5, threshold=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what was found in it is replaced by a mark."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, each of one lang."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), apart="lang")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secrets", secrets), ("mixture", mixture), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: None of the stages but the mixture can be written in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None
