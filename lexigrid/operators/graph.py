"""Bounded traversal of relationship edges, and unions of nested edge lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_hops(edges: DataFrame, start: str, hops: int, checkpoint_every: int = 3) -> DataFrame:
    """(name, hop) of nodes that at most so many undirected edges part from the start, with the least number; the start has 0.

    A frontier loop: each hop joins only the nodes that were new in the last one, against both directions of the edges.
    """
    spark = edges.sparkSession
    out = edges.select(F.col("source_name").alias("name"), F.col("target_name").alias("other"))
    both = out.unionByName(edges.select(F.col("target_name").alias("name"), F.col("source_name").alias("other"))).where("name is not null and other is not null")
    seen = frontier = spark.createDataFrame([(start, 0)], "name string, hop int")
    for hop in range(1, hops + 1):
        new = frontier.select("name").join(both, "name").select(F.col("other").alias("name")).distinct()
        frontier = new.join(seen.select("name"), "name", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
        if hop % checkpoint_every == 0 and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            seen = seen.checkpoint()
            frontier = seen.where(F.col("hop") == hop)
    return seen


def flat_entries(df: DataFrame, key: str, lists: dict[str, str]) -> DataFrame:
    """One row for each struct of several list columns, with the kind its column stands for."""
    each = [df.select(key, F.lit(kind).alias("kind"), F.inline(column)) for column, kind in lists.items()]
    return reduce(DataFrame.unionByName, each)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()
