"""Connected components of an edge table, without collecting it: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("_n")).agg(F.min(other).alias("_m"))


def components(edges: DataFrame, a: str, b: str, at: str) -> DataFrame:
    """(node, root) for every node with an edge; the root is the least node of its component.

    In a large star a node links its larger neighbours to the least node it knows, in a small star its smaller ones;
    after a number of rounds in the logarithm of the size every component is a star around its least node. Each round
    is written in the shared folder. Nodes with very many edges are reduced by partial aggregation, and the least
    neighbours are written before they are joined: both sides of the joins are then shuffled for them alone, so that Spark can split a node's edges.
    """
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = stored(now, f"{at}/round-0")
    mark, k = None, 0
    while True:
        k += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(_least(both, "a", "b"), f"{at}/known-{k}")
        large = both.join(least, F.col("a") == F.col("_n")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("_m", "a").alias("b")).distinct()
        large = stored(large, f"{at}/large-{k}")
        least = stored(_least(large, "a", "b"), f"{at}/least-{k}")
        small = large.join(least, F.col("a") == F.col("_n")).filter(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        now = stored(small.unionByName(least.select(F.col("_n").alias("a"), F.col("_m").alias("b"))).distinct(), f"{at}/round-{k}")
        for name in (f"round-{k - 1}", f"known-{k}", f"large-{k}", f"least-{k}"):
            discard(now.sparkSession, f"{at}/{name}")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    roots = now.select(F.col("b").alias("a"), "b").unionByName(now).distinct()
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root"))
