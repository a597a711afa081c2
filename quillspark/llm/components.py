"""Connected components of links, without ever collecting a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node of its component, for every node of the edges (a, b) of bigint.

    Contraction: each node moves to its least neighbour, on to that one's least
    neighbour and so on by pointer doubling until it stands on a local minimum;
    edges follow, loops and copies disappear, until no edge is left.  Doublings
    and rounds are logarithmic, on a chain too.  NULL ends and loops are ignored; no
    edges give no rows.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    moves: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("root")), f"{name}-step")
        while True:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("end"))
            move = materialise(step.join(onward, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), f"{name}-move")
            step = move.select("node", "root")
            if move.where("moved").isEmpty():
                break
        move = step
        moves.append(move)
        to_a = move.select(F.col("node").alias("a"), F.col("root").alias("x"))
        to_b = move.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = edges.join(to_a, "a").join(to_b, "b").where("x <> y")
        edges = materialise(left.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), name)
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # Later moves are of roots of earlier ones: follow them from the last to the first.
    found = moves[-1]
    for move in reversed(moves[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("end"))
        found = move.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return found
