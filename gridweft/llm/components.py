"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.session import materialize


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """One step: the neighbours ``v`` of ``u`` are linked to the smallest of them.  Each pair names a node and a neighbour."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if keep_larger:
        return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    ends = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return ends.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b")


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node`` and ``component`` (the smallest node that it is joined to) for every node with an edge to another.

    ``edges`` has two columns of long, in any direction; loops and repeats do no harm.  A round costs two aggregations, which
    combine before they shuffle, and two joins on a node; its result is written, so that rounds do not repeat one another and a
    lost executor repeats one round at most.  The number of rounds follows the logarithm of the longest path.
    """
    a, b = (F.col(c) for c in edges.columns)
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, f"{name}-edges")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = _star(both, True).distinct()
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).distinct()
        edges = materialize(small, f"{name}-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(now)
