"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def connected_components(edges: DataFrame, src: str, dst: str, cut: Callable[[DataFrame], DataFrame], rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges``; ``component`` is the smallest node that it reaches.

    ``cut`` materialises a round's edges in storage that all executors share (a checkpoint or a written
    table). Each round is two aggregations and two joins on the node, and the number of rounds grows with the
    logarithm of a component's diameter. Only a count and a checksum of the edges reach the driver. Edges with
    a null end are dropped; a node whose only edge is to itself is its own component.
    """
    edges = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    loops = edges.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    now, seen = cut(edges.filter("u <> v").distinct()), None
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component")).union(loops).groupBy("node").agg(F.min("component").alias("component"))
