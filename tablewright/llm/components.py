"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Neighbours from which on a node is hot: at most a millionth of the pairs are such nodes.
HOT = 1_000_000


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours. The minimum is pre-aggregated before the shuffle.

    Nodes of more than HOT neighbours, of which there are few, meet their pairs by broadcast, so that the
    pairs of a star's centre stay where they are.
    """
    least = checkpointed(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hot = least.where(F.col("n") > HOT).select("u", "m")
    met = pairs.join(least.select("u", "m"), "u")
    if hot.limit(1).count():
        rest = pairs.join(F.broadcast(hot), "u", "left_anti").join(least.where(F.col("n") <= HOT).select("u", "m"), "u")
        met = pairs.join(F.broadcast(hot), "u").unionByName(rest)
    return met.select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v longs); root is the least node of its component.

    Large-star links each larger neighbour of a node to the least of its neighbourhood, small-star
    links each smaller one; both keep components whole and together they end in stars after a number
    of rounds that grows with the logarithm of the component's size. Edges with a null end and loops
    are ignored; repeated edges count once. Only the number of edges and a checksum reach the driver.
    """
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(now)
    while seen[0]:
        both = checkpointed(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _nearest(checkpointed(large))
        now = checkpointed(near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        if (digest := _digest(now)) == seen:
            break
        seen = digest
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
