"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge: the smallest node of its component.

    ``edges`` has two long columns ``a, b``. Alternating star contraction: every node first hands its larger
    neighbours to its smallest neighbour, then its smaller ones. Rounds grow with the logarithm of the
    component, not with its diameter. Neighbourhoods are only ever reduced to their minimum, so a hub with
    very many neighbours needs no list. Each round is written to the shared folder, which cuts the lineage.
    Loops and repeated edges are harmless, edges with a null end are ignored, no edges give no rows.
    """
    now = (edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = materialise(now, "edges")
    seen = _state(now)
    while seen[0]:
        now = materialise(_small_star(_large_star(now)), "edges")
        state = _state(now)
        if state == seen:
            break
        seen = state
    # at the fixed point every edge leads from a node straight to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # all edges point from the larger to the smaller node here
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
