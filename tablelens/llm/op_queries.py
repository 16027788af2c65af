"""The registered queries of this subpackage: thin digests over the operators.

``op_queries.QUERIES`` and ``op_queries.ORACLES`` are added by the entry module
when the subpackage is present.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counts, filter_audit, licenses, neighbours, packing, pii, quality, secrets, simhash, suffix
from . import toxicity, variants
from .common import read_documents, shared_folder


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "quality")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(read_documents(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_documents(spark, sf_dir))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return neighbours.search(rows, rows.filter(F.col("id") % neighbours.EVERY == 0))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read_documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = counts.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    versions = {
        "words-1": counts.word_tokenizer,
        "byte_bpe_50k-1": counts.rank_tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                                public_tokenizers.PATTERN),
    }
    return counts.change_feed(rollup, read_documents(spark, sf_dir), versions)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(read_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_byte_level_bpe": op4_byte_level_bpe,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_license_scans": op7_license_scans,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_pii": op9_pii,
    "op10_token_counts": op10_token_counts,
    "op11_toxicity": op11_toxicity,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
    "op13_spelling_variant_grouping": op13_spelling_variant_grouping,
}

ORACLES: dict[str, str] = {
    "op7_license_scans": licenses.scan_sql(),
    "op12_filter_interaction_audit": filter_audit.audit_sql(),
}
