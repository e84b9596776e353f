"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, size, spread_join


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that is reachable) for all nodes of edges (a, b).

    Each round points every node to its smallest neighbour, shortens those paths, and contracts the
    edges to what they point to; each round at least halves the nodes that still have edges. Sums
    over a node's neighbours are combined before the shuffle, and the joins have one row for each
    node on one side, so a hub's rows are spread. Rounds are written to the shared folder.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count("*").alias("times")).select("node", F.least("node", "least").alias("to"), "times"), "pointers")
        known = size(to, "times")
        for _ in range(2):
            nearer = to.select(F.col("node").alias("to"), F.col("to").alias("further"), "times")
            to = spread_join(to, nearer, ["to"], "times", F.col("node"), known).select("node", F.coalesce("further", "to").alias("to"), "times")
        to = materialize(to, "pointers")
        if found is None:
            found = to.select("node", F.col("to").alias("component"))
        else:
            step = to.select(F.col("node").alias("component"), F.col("to").alias("further"), "times")
            found = materialize(spread_join(found, step, ["component"], "times", F.col("node"), known).select("node", F.coalesce("further", "component").alias("component")), "components")
        left, right = to.select(F.col("node").alias("a"), F.col("to").alias("x"), "times"), to.select(F.col("node").alias("b"), F.col("to").alias("y"), "times")
        moved = spread_join(spread_join(edges, left, ["a"], "times", F.col("b"), known), right, ["b"], "times", F.col("a"), known)
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
