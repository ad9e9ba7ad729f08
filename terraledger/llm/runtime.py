"""What the corpus operators share: batches of bounded size, tables of a scale folder, and expressions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraledger.session import new_path, reachable, shared_dir, written

#: The white space of the operators' contracts, as the inside of a regex class.
WS = r"\x20\x09-\x0D"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Actions within hand Python at most so many rows at once, which bounds memory where rows are large."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


__all__ = ["WS", "arrow_rows", "new_path", "partitions", "shared_dir", "table", "text_or_empty", "written"]
