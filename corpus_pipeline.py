"""The corpus pipeline: quality, near duplicates, decontamination, mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept. The first four return the columns of ``docs``; the last one adds slot, shard and
map_version. What a stage decides shows in its rows: rejected texts, all but one of
each group of near duplicates, passages of test items and documents beyond the mix's
budget are gone.

Nulls, empty and long texts, repeated rows, empty tables and clashing names are
handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, near_dedup, quality, sharding
from tessera.llm.shared import written
from tessera.session import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that read like trusted text of their language."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicate(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of test items."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix by source weights within the token budget."""
    return mixing.take_mix(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard."""
    return sharding.shard(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("source_mix", mix_stage),
    ("sharding", shard_stage),
]

#: The quality model has no SQL form, so neither has the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table of documents; each stage is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
