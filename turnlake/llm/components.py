"""Connected components by alternating large-star and small-star steps (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _linked_to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours are linked to the least node around it instead.

    large-star (``larger_only``) moves the larger neighbours, small-star the smaller ones and the node itself.
    """
    if larger_only:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        # repeated edges stay until the small-star, whose minima they do not change
        return both.filter("other > node").join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b")).filter("a <> b")
    else:
        down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        least = down.groupBy("node").agg(F.min("other").alias("least"))
        moved = down.join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b"))
        moved = moved.union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return moved.filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; ``component`` is the least node that links reach.

    Nodes are of any ordered type. Null ends and loops are ignored, repeated edges count once. Every round halves the
    depth of the trees at least, so rounds grow with the logarithm of the longest path; each round's edges are written to
    the shared folder. No node's neighbours are ever gathered in one place: minima are combined before the shuffle, and
    the join on a hub is one that adaptive execution splits.
    """
    links = stored(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
        .filter("x and y and a <> b").select("a", "b").distinct(),
        "links",
    )
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        links = stored(_linked_to_least(_linked_to_least(links, True), False), "links")
        # a star forest: no node is both a leaf and a centre, and the edges did not change
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def joined_components(component: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) once ``edges`` (a, b) have joined the components of ``component``; nodes that it lacks are their own before.

    Only the edges between different components are followed, each as one between their least nodes.
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    nodes = stored(component.unionByName(ends.join(component.select("node"), "node", "left_anti").withColumn("component", F.col("node"))), "nodes")
    at = lambda end, name: nodes.select(F.col("node").alias(end), F.col("component").alias(name))
    between = edges.select("a", "b").join(at("a", "x"), "a").join(at("b", "y"), "b").select("x", "y").filter("x <> y")
    merged = connected_components(between, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("least"))
    return nodes.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
