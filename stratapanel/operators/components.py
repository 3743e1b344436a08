"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratapanel.session import materialize


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node id of each component.

    Every node moves to its smallest neighbour's own move and the edges move along; edges within a
    node vanish, so the graph shrinks fast, until no edge is left. Every round is written out, which
    keeps the plan short and survives lost executors.
    """
    labels = nodes.select("node", F.col("node").alias("component"))
    edges = _distinct_edges(edges)
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))
        first = nearest.select("id", F.least("id", "to").alias("to"))
        second = first.select(F.col("id").alias("to"), F.col("to").alias("further"))
        moves = materialize(first.join(second, "to").select("id", F.col("further").alias("to")), "moves")
        ends = [moves.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b")
        edges = _distinct_edges(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))
        labels = _relabelled(labels, moves.select(F.col("id").alias("component"), "to"))
    return materialize(labels, "labels")


def _distinct_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, smaller end first, loops left out."""
    ordered = edges.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")
    )
    return materialize(ordered.distinct(), "edges")


def _relabelled(labels: DataFrame, moves: DataFrame) -> DataFrame:
    joined = labels.join(moves, "component", "left")
    return joined.select("node", F.coalesce("to", "component").alias("component"))

