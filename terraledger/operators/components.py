"""Connected components of an edge list, distributed: large-star and small-star in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.session import new_path, removed, written


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node it reaches.

    Each round hangs the neighbours of a node on its smallest neighbour, first the larger ones, then
    the smaller ones; it ends when every edge leads to the smallest node of its component. The join
    of edges with minima is a plain equi-join, so AQE splits a hub's partition; nothing is collected.
    A round's tables are deleted once the next round's edges are written.
    """
    spark, tables = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        tables.append(new_path(spark, name))
        return written(df, name, tables[-1])

    now = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours. The minima
        # are written, so that both sides of the join shuffle for it and AQE can split a hub's rows.
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = kept(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # Small star: u and its smaller neighbours go to the smallest of them.
        small_least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = kept(small)
        for path in tables[:-1]:
            removed(spark, path)
        del tables[:-1]
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
