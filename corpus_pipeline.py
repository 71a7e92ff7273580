"""The text pipeline: each stage calls one operator of ``telvane.llm`` on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telvane.llm import op3_language_filters, op4_simhash_windows, op6_signature_trees, op9_temperature_mixing, op10_prefix_shards
from telvane.llm.common import Scratch, documents
from telvane.llm.op6_signature_trees import one_of_each
from telvane.session import ship_package


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a known language."""
    ship_package()
    return op3_language_filters.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    ship_package()
    return one_of_each(docs, op6_signature_trees.jaccard_components(docs, k=5, p=4, q=5))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return op4_simhash_windows.drop_leaks(docs, documents(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources up to twice."""
    return op9_temperature_mixing.mix(docs, repeats=2.0).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document."""
    return op10_prefix_shards.shard(op10_prefix_shards.sized(docs), 16)


STAGES = [("language_id", languages), ("near_copies", near_copies), ("decontamination", leaks), ("mixing", mixture), ("sharding", shards)]
#: Language models and similarity components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.settle(stage(spark, docs, sf_dir), name)
    return docs
