"""From raw documents to packed training sequences, stage by stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents that the next stage gets, the last one the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stackpool.llm import minmax, packing, quality, secrets
from stackpool.llm.common import small_batches
from stackpool.session import materialise, ship_package

CAPACITY = 2048
#: Words of a shingle of near_dedup.
WIDTH = 5


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    _prepare(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: 0.8 or more of their shingles of WIDTH words in common."""
    _prepare(spark)
    return minmax.keep_first(docs, width=WIDTH)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced."""
    _prepare(spark)
    return secrets.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of CAPACITY tokens."""
    _prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Classifier, tokenizer and hashing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
