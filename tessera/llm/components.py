"""Connected components of a table of links, by alternating stars, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other, which hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("hangs")))
    worst = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least")).filter("hangs > 1 or (hangs = 1 and least = 0)")
    return worst.isEmpty()


def _least(edges: DataFrame) -> DataFrame:
    """The least of each u and its neighbours a."""
    return edges.groupBy("u").agg(F.min("a").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): of every node with a link to another, the least node that its links reach.

    A step hangs the greater neighbours of a node on the least of it and its neighbours; the next the smaller ones
    and itself; and so on, until all hang on the least of their component, after about the logarithm of the longest
    chain. Least neighbours are partial aggregates, so a node with very many links is no hot key there, and Spark
    splits its rows in the join. Steps are written to the shared folder. Links of a node to itself and nulls count
    for nothing.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("a")).filter("u > a").distinct()
    large = True
    while True:
        if large:
            sides = edges.unionByName(edges.select(F.col("a").alias("u"), F.col("u").alias("a")))
            found = sides.join(_least(sides), "u").filter("a > u").select(F.col("a").alias("u"), F.col("m").alias("a"))
        else:
            least = _least(edges)
            found = edges.join(least, "u").select(F.col("a").alias("u"), F.col("m").alias("a")).unionByName(least.select("u", F.col("m").alias("a")))
        edges = staged(found.filter("u > a").distinct(), "links")
        if _are_stars(edges):
            break
        large = not large
    stars = edges.select(F.col("u").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
