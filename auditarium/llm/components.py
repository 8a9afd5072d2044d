"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step is a minimum for each node (combined before the shuffle, so a hub's rows shrink where they are) and a
join back on the node, which the planner can split where a hub is hot. Steps end in tables of the shared folder.
Nothing of the graph goes to the driver but its size and a checksum, which tell when it no longer changes.

Edges with a null end are left out, repeated edges count once, an edge from a node to itself makes no component; without edges there are no rows. Nodes may be of any type that has an order; other
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges a > b after one step. edges: a > b, distinct."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(back) if large else edges
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    if large:  # larger neighbours are tied to the least
        out = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # the node and its smaller neighbours are tied to the least
        out = edges.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows node, component (its least node) of the nodes of edges a, b; nodes without edges don't occur."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        edges = written(_stars(_stars(edges, True), False), "edges")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
