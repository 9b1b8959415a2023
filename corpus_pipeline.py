"""Clean a table of documents in four stages: quality, near duplicates, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of the
documents they keep.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfkin.llm import bbit_minhash, bpe, fm_decontam, quality_gbdt
from shelfkin.llm.common import table
from shelfkin.llm.queries import TOKENIZER
from shelfkin.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by gradient-boosted trees, trained on ``labels``, reaches the threshold."""
    labels = table(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality")
    return quality_gbdt.keep_good(docs, labels)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return bbit_minhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the items of ``benchmark``."""
    items = table(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return fm_decontam.remove_contaminated(docs, items)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    return bpe.round_trip_digests(table(docs, "doc_id", "text"), public_tokenizers.path(TOKENIZER)).drop("text")


STAGES = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", one_of_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("bpe_encoding", encoded),
]

# Training, similarity and tokens are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
