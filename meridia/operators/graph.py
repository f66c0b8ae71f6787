"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpointed, drop_checkpoint


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: no node hangs from two others, or from one that hangs itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("top")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("top"))
    )
    per = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("top").alias("top"))
    return per.filter("leaf + top > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b); the root is the smallest node of the component.

    A round costs a few shuffles of the remaining edges and is checkpointed, and the
    round before is deleted; the number of rounds grows with the logarithm of the
    longest chain.  Least neighbours are combined before the shuffle, and a hub's edges
    meet its one row in an inner join that adaptive execution splits.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    state = checkpointed(pairs.filter("a < b").distinct())
    while not _settled(state):
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            state.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").filter("v > u and m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        )
        # small star: u and its smaller neighbours are tied to the smallest of them
        floor = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(floor, "b")
            .select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(floor.select(F.col("m").alias("a"), "b"))
            .filter("a < b")
            .distinct()
        )
        last, state = state, checkpointed(small)
        drop_checkpoint(last)
    heads = state.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(heads)
