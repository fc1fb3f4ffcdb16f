"""A training corpus from documents: quality, unwanted texts, near-duplicates, benchmark passages, packing.

Each stage takes `(spark, docs, sf_dir)`. All but the last return the documents they keep, with the
columns they came with; the last returns where each piece of each document lies in the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from muralog.llm import decontamination, importance, packing, quality_rules, simhash_dedup
from muralog.llm.ship import ship
from muralog.sources.scratch import stage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
WINDOW = 4096
# What the classifier samples of the documents that the quality rules leave.
SHARE = 0.87


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return importance.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash_dedup.first_of_each(docs, shingle=3, radius=2)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.piece_digests(docs, TOKENIZER, END_ID, WINDOW)


STAGES = [
    ("quality rules", quality),
    ("quality classifier", classifier),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]

# Tokenizer, SimHash and the hashed models are outside of SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
