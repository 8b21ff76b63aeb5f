"""Connected components by alternating large and small stars, each step a few joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import dropped, stored


def _least(pairs: DataFrame) -> DataFrame:
    """The least of a node and its neighbours; summed before the shuffle, so a hub is no burden."""
    return pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of the edges (a, b) the least node that it is connected to."""
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    current = stored(ordered.distinct(), "edges")
    state = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large-stars")
        least = _least(large)
        near = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = near.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        after = stored(small.distinct(), "small-stars")
        dropped(current, large)
        current, before, state = after, state, _state(after)
        if state == before:
            break
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
