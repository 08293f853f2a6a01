"""The corpus pipeline: quality rules, near-copies, repeated passages, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import circulant_minhash, debruijn_dedup, decontamination, packing, quality_rules
from kinfold.sources.scratch import materialize

TOKENIZER = "word_bpe_49k.json"
#: Similarity of 5-word shingles from which documents are near-copies here (op4 has its own), and bands that find it.
NEAR_PERCENT, NEAR_BANDS = 80, 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.drop_rejected(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return circulant_minhash.drop_near_copies(docs, NEAR_PERCENT, NEAR_BANDS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; every document stays."""
    return debruijn_dedup.remove_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packed),
]

# The stages hash, link and tokenize whole texts over several rounds; SQL cannot express them. Tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
