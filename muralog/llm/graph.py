"""Connected components of a large edge table, in rounds of ordinary joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralog.sources.scratch import stage

MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """`vertex`, `root` for every vertex of the edges `a`, `b`: the root is the smallest reachable vertex.

    Alternates two steps on the edge table until it is a set of stars: every vertex ties its larger
    neighbours to the smallest vertex it knows, then its smaller ones. Each round is a written table,
    so a lost executor costs one round at most. A vertex with very many neighbours is aggregated with
    map-side combine, and its neighbours are tied through a join on it, which Spark splits if skewed.
    """
    current = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if not current.take(1):
            break
        after = stage(_smaller(_larger(current)), "edges")
        if after.exceptAll(current).isEmpty() and current.exceptAll(after).isEmpty():
            break
        current = after
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("root"))


def _larger(edges: DataFrame) -> DataFrame:
    """Each vertex ties its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    """Each vertex ties itself and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(smallest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
