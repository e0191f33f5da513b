"""Connected components of a graph given by its edges, by alternating star contractions.

Each round points neighbours at the least node they know of: the large-star step moves a node's larger
neighbours, the small-star step its smaller ones. Degrees don't matter, as minima are partial aggregates
and the edge joins are split by Spark where a node has very many edges. Each round is checkpointed, and
the edges never leave the executors. A round has as many tasks as its edges need, not as many as a shuffle has partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, pinned


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return gathered(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")), n)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return gathered(gathered(moved.unionByName(low.select("a", F.col("low").alias("b"))), n).distinct(), n)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges: a and b, of one ordered type; loops are ignored. Returns (a, b): each node that has an edge and is
    not the least of its component, with that least node."""
    now = pinned(edges.filter("a <> b").select("a", "b").distinct())
    n, sign = now.count(), None
    now = gathered(now, n)
    for _ in range(most):
        now = pinned(_small_star(_large_star(now, n), n))  # never more edges than there were
        was, sign = sign, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == was or not sign[0]:
            return now
    raise RuntimeError(f"components have not settled after {most} rounds")
