"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapheur.session import written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(a, least of a and its neighbours); the minimum is taken on the map side first, so a hub is no burden."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); a component is named after its least node.

    Loops and repeated edges are allowed, null ends are dropped, no edges give an empty result. Every step cuts the lineage
    in the shared folder. The number of steps grows as the square of the logarithm of the nodes at worst.
    """
    edges = written(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least_neighbour(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = _least_neighbour(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = written(small, "edges")
        same = edges.exceptAll(after).isEmpty() and after.exceptAll(edges).isEmpty()
        edges = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
