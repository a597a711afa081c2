"""Citation graph: one hop forwards and backwards, snowballing, co-citation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def hop(edges: DataFrame, seeds: DataFrame, forward: bool) -> DataFrame:
    """(node): what the seeds cite (backward) or what cites them (forward); edges are (citing, cited)."""
    here, there = ("cited", "citing") if forward else ("citing", "cited")
    return edges.join(seeds.select(F.col("node").alias(here)), here, "left_semi").select(F.col(there).alias("node")).distinct()


def snowball(edges: DataFrame, seeds: DataFrame, rounds: int, forward: bool = False) -> DataFrame:
    """(node, round): nodes first reached in each round, the seeds in round 0; ends early when a round adds nothing."""
    found = materialise(seeds.select("node").distinct().withColumn("round", F.lit(0)), "snowball")
    for number in range(1, rounds + 1):
        front = found.where(F.col("round") == number - 1)
        new = materialise(hop(edges, front, forward).join(found, "node", "left_anti").withColumn("round", F.lit(number)), "snowball")
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


def co_cited(edges: DataFrame, piece: int = 1000) -> DataFrame:
    """(a, b, n): how many works cite both, a < b; repeated citations of a work count once.

    The references of a work that cites more than ``piece`` are cut into pieces of
    about that size, each of which meets all of its references in a task of its own.
    """
    e = edges.where("citing is not null and cited is not null").distinct()
    pieces = e.groupBy("citing").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("_p"))
    full = e.join(pieces, "citing")
    left = full.select("citing", F.col("cited").alias("a"), F.pmod(F.hash("cited"), F.col("_p")).alias("_k"))
    right = full.select("citing", F.col("cited").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_k"))
    return left.join(right, ["citing", "_k"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
