"""Labelled rows for the learned operators: which rows may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import text_or_empty


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def sample(docs: DataFrame, labels: DataFrame, label: str, at_most: int) -> DataFrame:
    """(y, text) of at most at_most labelled documents of the teaching folds.

    A document labelled twice counts once, with its smallest label; rows without id or label teach
    nothing. The choice goes by a hash of the id, so it does not depend on order or source.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    chosen = usable.filter(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)
    # at_most rows of two numbers: bounded, so it is broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # Rows that share an id count once, so no more than at_most come back.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
