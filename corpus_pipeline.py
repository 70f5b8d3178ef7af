"""The corpus pipeline: rules, near-duplicates, decontamination, mixing, sharding.

Each stage works on all documents that the one before it kept and returns their columns; the last adds ``shard`` and
``slot``. What a stage does with nulls, empty texts, repeated rows and empty tables is told by its operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, histogram_shards, mix_sources, quality_rules, simhash_dedup
from graphloom.llm._common import shared_folder, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources.mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return histogram_shards.shard_documents(docs)


STAGES = [("quality rules", rules), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The near-duplicate and decontamination stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{i}")
            docs = spark.read.parquet(f"{place}/{i}")
    return docs
