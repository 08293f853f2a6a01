"""The operators of this subpackage as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import (
    blob_ledger,
    circulant_minhash,
    cotraining,
    debruijn_dedup,
    decontamination,
    id_blocks,
    lexical_trees,
    packing,
    quality_rules,
    revisits,
    suffix_dedup,
    url_reputation,
    whitening,
)
from kinfold.sources.scratch import new_location

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_reputation(spark, sf_dir):
    return url_reputation.url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_circulant_minhash(spark, sf_dir):
    return circulant_minhash.near_copies(table(spark, sf_dir, "documents"))


def op5_revisits(spark, sf_dir):
    return revisits.revisit_report(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op7_cotraining(spark, sf_dir):
    docs, labels, pages = (table(spark, sf_dir, name) for name in ("documents", "labels", "pages"))
    return cotraining.quality_scores(docs, labels, pages)


def op8_id_blocks(spark, sf_dir):
    files = id_blocks.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return id_blocks.id_digests(files)


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_debruijn_dedup(spark, sf_dir):
    return debruijn_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op11_blob_ledger(spark, sf_dir):
    ledger = blob_ledger.create(spark, new_location(spark, "blob-ledger"))
    return blob_ledger.secret_digests(table(spark, sf_dir, "documents"), ledger)


def op12_feast_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_document_fp_tree(spark, sf_dir):
    return lexical_trees.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def all_queries() -> dict[str, Query]:
    named = [
        op1_quality_rules,
        op2_decontamination,
        op3_url_reputation,
        op4_circulant_minhash,
        op5_revisits,
        op6_suffix_dedup,
        op7_cotraining,
        op8_id_blocks,
        op9_packing,
        op10_debruijn_dedup,
        op11_blob_ledger,
        op12_feast_whitening,
        op13_document_fp_tree,
    ]
    return {query.__name__: query for query in named}
