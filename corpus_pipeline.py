"""From raw documents to packed training sequences; every stage is one operator of ``lintlake.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import exact_dedup, mixing, near_dedup, packing, quality
from lintlake.llm.scratch import documents, keep


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of ``docs``, does not reject."""
    return quality.accepted(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(spark, docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicate(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the source weights ask for."""
    return mixing.mixed_documents(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in their training sequences."""
    return packing.pack_tiers(spark, docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("near dedup", distinct_contents),
    ("mixing", mixed),
    ("packing", packed),
]
#: No SQL expresses a trained classifier or random rounding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
