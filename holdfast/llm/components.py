"""Connected components by alternating large-star and small-star.

Each operation is a grouping and a join of the edges, and its result is written to a table, so the plan
stays short and a lost executor costs one step. A node's smallest neighbour comes from an aggregation
that starts before the shuffle; the join that follows lets Spark divide a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.workspace import materialise


def _with_smallest(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` with ``m``, the smallest of ``u`` and its neighbours."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(smallest, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    found = _with_smallest(edges.filter("u > v"))
    own = found.select("u", F.col("m").alias("v"))
    others = found.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` for every node but the smallest of its component, ``v`` being the smallest.

    ``edges``: pairs ``u, v`` of numbers in any order; loops and repeated pairs do no harm.
    """
    oriented = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialise(oriented, "star"), None
    while True:
        now = materialise(small_star(materialise(large_star(now), "large-star")), "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now
        before = state
