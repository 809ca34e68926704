"""Connected components on DataFrames by alternating star contraction.

Each round is one large-star and one small-star step: every step is an
aggregation (combined on the map side, so a hub's edges become one row for
each task) and an equi-join, which AQE splits for hot nodes.  The number of
edges never grows, rounds are logarithmic in practice, and each round's edges
are written to the shared folder.  The rounds end when all edges form stars;
nothing but that answer is sent to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least_neighbour(edges)
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node either points to one smaller node that points nowhere, or is pointed to."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    mixed = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("lo"))
    return mixed.filter("ups > 1 OR (ups > 0 AND lo = 0)").isEmpty()


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node with an edge to another node; the
    component is its smallest node.  Null ends and loops are ignored."""
    edges = save(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
                 .filter(F.col(src) != F.col(dst)).distinct())
    while not _all_stars(edges):
        # A large-star edge points from the greater to the smaller node, as a small-star step wants it.
        edges = save(_small_star(_large_star(edges)))
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
