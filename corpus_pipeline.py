"""The corpus pipeline: quality, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. What a stage returns is written as
Parquet in the shared folder and read again as the next one's docs.

Defined results: empty tables give empty results; without labels or a benchmark the first and third stage keep all rows; a
null or empty text is scored like any other, is a class with all others of its kind, leaks nothing, and is mixed as often as
the whole part of its source's ratio; rows alike become one in the second stage; a null source is one of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontam, mixing, neardup, quality, sharding
from tidewell.llm.common import scratch, stored

#: Documents that score below this go. Lower than the classifier's own threshold, to keep clean documents.
ACCEPT = 0.5


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to their labels, accepts."""
    return quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=ACCEPT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Random rounding, a fitted model and sketches have no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):  # a stage's own tables go once its result is written
            docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), keep=True)
    return docs
