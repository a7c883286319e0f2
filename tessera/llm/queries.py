"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontaminate, licenses, lm, mixing, near_dedup, neighbours, quality, sharding, token_counts
from tessera.session import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard", "map_version")


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality": op3_quality,
    "op4_license_scan": op4_license_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_chat_format": op6_chat_format,
    "op7_token_counts": op7_token_counts,
    "op8_nearest": op8_nearest,
    "op9_source_mix": op9_source_mix,
    "op10_sharding": op10_sharding,
}
ORACLES = {
    "op6_chat_format": chat.ORACLE,
    "op9_source_mix": mixing.ORACLE,
    "op10_sharding": sharding.ORACLE,
}
