"""A training-data pipeline over ``documents``: rules, line and near-duplicate removal, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, line_dedup, packing, quality_rules, secret_scan
from lodestone.llm._common import durable
from lodestone.llm.queries import MERGES


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their perplexity reject go."""
    return quality_rules.keep(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from all documents but the first that has them."""
    return _recounted(line_dedup.remove(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 stays."""
    return jaccard_join.representatives(docs, size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return _recounted(secret_scan.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path(MERGES))


STAGES = [("quality rules", quality), ("line dedup", boilerplate), ("n-gram Jaccard join", near_copies), ("secret scans", secrets), ("packing", packed)]

#: Perplexity and tokens are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):  # stages read their input several times
            docs = durable(docs, f"stage{i}")
    return docs
