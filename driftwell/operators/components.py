"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.storage import drop_stash, stash


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: every node ties its larger neighbours to its least one; small: its smaller ones and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``edges`` (a, b) of any ordered type to ``(node, component)``: the least node that each node reaches.

    Nodes without an edge to another node are not in the result. Each round costs two aggregations whose joins AQE can
    split where a node is hot, and is written to the shared folder, so plans stay short and a lost executor costs a round
    at most. The number of rounds grows with the logarithm of the longest path;
    beyond ``most_rounds`` it raises.
    """
    now = stash(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        new = stash(_stars(_stars(now, large=True), large=False), "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stash(now)
        now = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components have not converged after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
