"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import materialize


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star round: the neighbours of a node (only smaller ones, or only larger ones) are tied to the least of them.
    Minima are combined before the shuffle; nothing is collected for a node."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("least", "u"))
    moved = both.join(least, "u")
    if not small:
        moved = moved.where("v > u")
    ties = moved.select(F.col("v").alias("u"), F.col("least").alias("v"))
    if small:
        ties = ties.unionByName(least.select("u", F.col("least").alias("v")))
    return ties.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root (the least node reachable) for every node of `edges` (u, v) with a smaller one in reach.

    Alternates large and small stars until nothing moves, which takes a logarithmic number of rounds. Every round is
    written to the shared folder, so a lost executor costs one round at most.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges = materialize(edges, "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        edges = materialize(_stars(_stars(edges, small=False), small=True), "edges")
