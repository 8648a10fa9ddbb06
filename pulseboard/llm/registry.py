"""The operators' queries over the given tables: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, decontaminate, line_dedup, lm, packing, pii, quality, runs, secrets, sharding, simhash, toxicity
from .common import table

#: Byte limit of a shard, in proportion to these tables (a cluster's would be some hundred MB).
SHARD_BYTES = 1 << 20
#: Rank file of the tokenizer; its ids are those of byte_bpe_50k.json.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ADDED = public_tokenizers.path("byte_bpe_50k.json")
#: Model of the second tokenizer that op12 aligns with it.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), RANKS, added=ADDED)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), 3, 3)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), ADDED, RANKS, PIECES)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scan, op2_packing, op3_lm_scoring, op4_line_dedup, op5_decontamination,
    op6_toxicity, op7_sharding, op8_quality_classifier, op9_nearest_neighbours, op10_simhash_dedup,
    op11_personal_data, op12_token_alignment, op13_periodic_runs)}
ORACLE: dict[str, str] = {"op4_line_dedup": line_dedup.ORACLE, "op7_sharding": sharding.ORACLE.format(limit=SHARD_BYTES)}
