"""Connected components of a link table, by alternating stars; everything stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.cluster import settle


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.select("u", "v").unionByName(back)


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """Least neighbour of every node; written down, so that joins with it can be split where a node is hot."""
    return settle(edges.groupBy("u").agg(F.min("v").alias("m")), "least").withColumnRenamed("u", "n")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node that a link names; a component is its least node's id.

    Links are (left, right) of one integer type, in any direction, repeats and loops
    allowed; those with a null are no links. Every round turns each node's links to
    its least neighbour, first among larger ones, then among smaller ones, until
    only stars remain: about as many rounds as the longest chain has doublings.
    """
    pairs = links.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).filter("a is not null and b is not null")
    edges = pairs.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = settle(edges, "links")
    alone = pairs.filter("a = b").select(F.col("a").alias("node"))
    state = _state(edges)
    while True:
        # Larger neighbours of u go to the least node that u sees.
        every = _both_ways(edges)
        least = _least_neighbours(every)
        to = F.least("u", "m")
        large = every.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), to.alias("v"))
        large = settle(large.filter("u != v").distinct(), "large-star")
        # u and its smaller neighbours go to the least of them.
        least = _least_neighbours(large)
        joined = large.join(least, F.col("u") == F.col("n"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = settle(small.filter("u != v").distinct(), "small-star")
        new = _state(edges)
        if new == state:
            break
        state = new
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    loops = alone.select("node", F.col("node").alias("component"))
    return stars.unionByName(centres).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
