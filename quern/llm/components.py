"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v longs); root is the smallest node that links reach.

    Each round writes its edges to the shared folder. Minima are pre-aggregated by task, and joins are between written
    tables or their sums, so a node with very many links isn't gathered anywhere. The number of rounds grows with
    the logarithm of the longest path.
    """
    edges = materialise(links.select("u", "v").filter("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        edges = materialise(_small(materialise(_large(edges).filter("u <> v").distinct(), "large-star")).distinct(), "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).collect()[0])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
