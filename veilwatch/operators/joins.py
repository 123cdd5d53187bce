"""Joins that hold up when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default of a job's ``salts``: the number of tasks one key's rows are spread over.  Set it to about the
#: number of cores times the share of the largest key.
SALTS = 16


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters can use as a finished value.

    Spark moves a filter on a projected column below the projection and puts the whole expression
    into it; over a chain of such columns the plan doubles at every step.  It does not move filters
    below an explode, and exploding a one-element array keeps every row.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str,
                spread: list[str], salts: int = SALTS, large: bool = False) -> DataFrame:
    """Join a large left side to a right side of small rows, hot keys spread over ``salts`` tasks.

    ``spread`` names left columns that tell rows of one key apart.  Every right row is repeated once
    per salt, so keep right rows narrow.  Rows with a null key are spread as well.  Spark still
    broadcasts the right side where its size allows; its estimate knows neither the repeats nor how many
    rows a packed text becomes, so a right side that grows with the data is called ``large`` and is sorted.
    """
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"a repeated right side cannot serve a {how!r} join")
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    repeated = right.withColumn("_salt", copies)
    return (left.withColumn("_salt", salt)
            .join(repeated.hint("merge") if large else repeated, [*keys, "_salt"], how)
            .drop("_salt"))
