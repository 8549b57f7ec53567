"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def connected(edges: DataFrame) -> DataFrame:
    """key, component (its least node) of every node of the edges ``a, b``; loops count as nodes.

    In each round every node moves to its least neighbour, if that is smaller, and then to where that one moved; edges
    follow their ends until none is left between two nodes. Nodes with many edges are counted by map-side minima.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left, labels = stored(both), None
    while not left.isEmpty():
        step = stored(left.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        jump = stored(step.alias("s").join(step.select(F.col("a").alias("to"), F.col("to").alias("far")), "to").select("a", F.col("far").alias("to")))
        if labels is None:
            labels = jump.select(F.col("a").alias("key"), F.col("to").alias("component"))
        else:
            moved = labels.join(jump.select(F.col("a").alias("component"), "to"), "component", "left")
            labels = stored(moved.select("key", F.coalesce("to", "component").alias("component")))
        half = left.join(jump, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(jump, "a")
        left = stored(half.where(F.col("x") != F.col("to")).select(F.col("x").alias("a"), F.col("to").alias("b")).distinct())
    return labels if labels is not None else both.select(F.col("a").alias("key"), F.col("b").alias("component"))
