"""Run a registered query in Spark and its SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import time
from collections import Counter

import duckdb

from registry.all import QUERIES, oracles

ORACLES = oracles()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


SECONDS = {"spark": 0.0, "sql": 0.0}  # of the last comparison


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_cell(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, Counter(tuple(_cell(r[i]) for i in at) for r in cur.fetchall())


UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas")


def unwanted_nodes(df) -> list[str]:
    """Plan nodes no registered query should have: cross products and Python workers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [f"plan has {node}" for node in UNWANTED if node in plan]


def differences(spark, con, name: str, sf_dir: str) -> list[str]:
    """Empty when equal, else a few lines that say what differs."""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    bad = unwanted_nodes(df)
    if bad:
        return bad
    cols, got = spark_rows(df)
    SECONDS["spark"] = time.time() - start
    if name not in ORACLES:
        return []
    start = time.time()
    want_cols, want = duck_rows(con, ORACLES[name])
    SECONDS["sql"] = time.time() - start
    if cols != want_cols:
        return [f"columns {cols} against {want_cols}"]
    if got == want:
        return [] if got else ["both results are empty"]
    out = [f"{sum(got.values())} rows against {sum(want.values())}"]
    out += [f"only Spark: {r}" for r in sorted(got - want)[:3]]
    out += [f"only SQL:   {r}" for r in sorted(want - got)[:3]]
    return out
