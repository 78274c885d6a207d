"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dealt_join, fair_share, hot_keys

#: Edges that one task takes in its stride: from more on, the edges of a
#: node with many of them are dealt out.
DEALT_FROM = 1 << 20


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the least node of its
    component.  Large-star and small-star steps alternate until the edges stay
    as they are: a number of rounds that grows with the logarithm of the
    component's size.  In the end a root has an edge to each of its nodes; the
    edges of such a node are dealt out to many tasks.  Each round's edges are
    checkpointed; nothing but one row of counts reaches the driver.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u != v")
    now = checkpointed(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _print(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both.filter("v > u"), both, seen[0]).select("v", F.least("u", "m").alias("m"))
        large = large.filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()
        small = _stars(large, large, seen[0]).select("v", "m").filter("v != m").unionByName(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m"))
        now = checkpointed(small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct())
        before, seen = seen, _print(now)
        if before == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _stars(edges: DataFrame, around: DataFrame, n: int) -> DataFrame:
    """(u, v, m): ``edges`` with the least v that u has in ``around``."""
    low = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = low.select("u", "m")
    if n < DEALT_FROM:
        return edges.join(least, "u")
    return dealt_join(edges, least, ["u"], hot_keys(low, ["u"], fair_share(2 * n, edges.sparkSession)))


def _print(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
