"""Connected components of links that no machine could hold: alternating large-star and small-star steps.

Each step makes every node's neighbours point at the smallest node they know of. A node with very many
links is only ever summed up (a partial minimum) or on the large side of a join, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, work: Workspace, name: str = "components", rounds: int = 60) -> DataFrame:
    """``edges``: a, b, two node ids. Returns ``node, component`` for every node but those that are the
    smallest of their component; loops and repeated edges do no harm."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = work.table(edges, f"{name}-0"), None
    for k in range(1, rounds + 1):
        moved = work.table(_small_star(_large_star(edges)), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
        edges = moved
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = seen
    raise RuntimeError(f"links did not settle in {rounds} rounds")
