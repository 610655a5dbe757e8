"""Connected components of a graph by alternating stars; every round is a written table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import staged


def are_stars(edges: DataFrame) -> bool:
    """Whether each u has one edge only and to a vertex that is no u itself; then v is the component of u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def connected_components(edges: DataFrame, stage: Callable = staged) -> DataFrame:
    """v and the smallest vertex it reaches, for edges (a, b); vertices without an edge do not appear.

    Each round hangs the larger neighbours of a vertex on its smallest one and then the smaller ones;
    the number of rounds grows with the logarithm of the longest chain.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stage(small, "small-star")
    return now.select(F.col("u").alias("v"), F.col("v").alias("component"))
