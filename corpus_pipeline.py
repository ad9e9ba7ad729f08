"""The corpus pipeline: rules, exact copies, near copies, mixing, packing; each stage's table is the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraledger.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from terraledger.llm.runtime import new_path
from terraledger.llm.tokens import default_tokenizer
from terraledger.session import reachable

#: Words whose ids a packing worker remembers: fewer than by default, as workers of the stages before share its memory.
CACHE_WORDS = 100_000


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    return near_dedup.near_dedup(docs, near_dedup.Params(words=5, percent=80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids: repeated and shortened documents cannot be told by doc_id."""
    return packing.pack(docs, default_tokenizer(), window=2048, end_id=1, keep_ids=True, cache_words=CACHE_WORDS)


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: Near copies and packing cannot be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
