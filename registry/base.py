"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.fixtures import oracle
from veilwatch.session import checkpoint_root

QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

JOINER = " | "
TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DUCK_TS = "%Y-%m-%d %H:%M:%S.%f"


def name_folder(spark: SparkSession) -> None:
    """Name a checkpoint folder for a local session that has none; a cluster names its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="registry-"))


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            name_folder(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn
    return add


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables a query writes and reads again."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def oracles() -> dict[str, str]:
    """The SQL of every query that has one, with the common table expressions it needs."""
    return {name: oracle(sql) for name, sql in _SQL.items()}


def joined(col) -> Column:
    return F.array_join(col, JOINER)


def joined_some(arr: str) -> Column:
    """The joined array, dropping rows where it is empty without working it out twice."""
    return F.explode(F.when(F.size(arr) > 0, F.array(joined(arr))).otherwise(
        F.array().cast("array<string>")))


def stamp(col) -> Column:
    return F.date_format(col, TS)


def number(col: Column) -> Column:
    return col.cast("bigint")


def flat_verdicts(df: DataFrame, *more: str) -> DataFrame:
    t = F.col("threat")
    return df.select(
        "event_id", "action", "verdict", number(F.col("masked")).alias("masked"),
        t["code"].alias("code"), t["tool"].alias("tool"), t["subject"].alias("subject"),
        joined(t["details"]).alias("details"), t["inner_code"].alias("inner_code"), *more)
