"""From raw documents to token ids: five operators, each on all that its predecessor kept.

Each stage is a function of (spark, docs, sf_dir) and returns a data frame; all but
the last return the columns of ``documents``. Results are written as Parquet and
read again between stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, mixing, near_dedup, phrases, quality_rules
from tessera.llm.shared import documents, saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every certified cutoff."""
    return quality_rules.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that stood earlier."""
    return phrases.remove_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that meet the domains' weights, as often as their copies say."""
    return mixing.mix_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count, ids (little-endian unsigned 32-bit) and the SHA-256 of what they decode to."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("repeated passages", substring_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", token_stage),
]

#: Certified cutoffs, components and fitted rates are beyond one SQL statement; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the whole of ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
