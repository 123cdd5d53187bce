"""Prefix sums over the pieces of one key in two levels, so that a key with many pieces is no one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of a group of the prefix sums; their texts are in one task.
GROUP = 64


def before(key: str, pieces: DataFrame, sums: list[str], lasts: list[str], group: int = GROUP,
           carried: tuple = (), grouped: bool = False) -> DataFrame:
    """``key``, ``piece`` and, of the pieces before it, the sum (``sums``) or last non-null value (``lasts``).

    Summed within groups of pieces first, then over the groups.  Columns ``carried`` go with their piece, so
    that wide ones are dealt once and need no join to come back to their sums; ``<sum>_all`` is a sum over
    the whole key then.  ``grouped`` keeps the group as ``_g``: the rows are dealt by ``key`` and ``_g``.
    """
    narrow = pieces.select(key, "piece", *sums, *lasts, *carried, F.floor(F.col("piece") / group).alias("_g"))
    inner = Window.partitionBy(key, "_g").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(key).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    within = narrow.select(key, "piece", "_g", *carried, *[F.sum(c).over(inner).alias(f"{c}_in") for c in sums],
                           *[F.last(c, ignorenulls=True).over(inner).alias(f"{c}_in") for c in lasts])
    totals = narrow.groupBy(key, "_g").agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("piece"))).alias(c) for c in lasts])
    over = totals.select(key, "_g", *[F.sum(c).over(outer).alias(f"{c}_out") for c in sums],
                         *[F.last(c, ignorenulls=True).over(outer).alias(f"{c}_out") for c in lasts],
                         *[F.sum(c).over(Window.partitionBy(key)).alias(f"{c}_all") for c in sums if carried])
    zero = F.lit(0).cast("bigint")
    return within.join(over, [key, "_g"]).select(
        key, "piece", *["_g"] * grouped, *carried, *[f"{c}_all" for c in sums if carried], *[(F.coalesce(f"{c}_in", zero) + F.coalesce(f"{c}_out", zero)).alias(c) for c in sums],
        *[F.coalesce(f"{c}_in", f"{c}_out").alias(c) for c in lasts])
