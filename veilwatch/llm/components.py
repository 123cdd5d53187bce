"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import settled


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` (least reachable node) for every node of the links; ids are ordered longs.

    Every step is a join and a group over the links, each written to the shared folder.  A step sends a
    node's links to the least neighbour; pairs of one neighbourhood are never built.  The number of
    steps grows with the logarithm of the longest chain.  The loop ends when no link changes.
    """
    edges = settled(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = settled(small)
        same = _fingerprint(now) == _fingerprint(edges)
        edges = now
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                    F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
