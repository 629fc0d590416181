"""Connected components of a graph given as an edge table, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequery.llm.common import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h or 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it reaches) of every node of ``edges(a, b)``; null ends and loops are dropped.

    Alternating large-star and small-star steps: each links neighbours straight to the smallest
    node around, so paths of n links fold in about log n rounds, and each round moves every link
    a fixed number of times, whatever a node's degree. Each round is checkpointed.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(below.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = cut(small)
        if (now := _state(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
