"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_format, fingerprints, mixing, near_dedup, oracles, phrases, quality_rules, sharding, suffix_tree, token_output
from .shared import documents


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    chats = chat_format.format_chats(turns.unionByName(chat_format.extra_conversation(spark)))
    return chat_format.digests(chats)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.repeat_digests(documents(spark, sf_dir))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_chat_format, op2_substring_dedup, op3_token_output, op4_quality_rules, op5_byte_bpe, op6_sharding, op7_fingerprints, op8_near_dedup, op9_mixing, op10_lm_scoring]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """For the others, the tests compare with brute force, exact round trips or held-out texts."""
    return dict(oracles.SQL)
