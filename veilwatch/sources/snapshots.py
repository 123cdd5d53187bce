"""Process snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_SCHEMA = ("host string, snapshot_ts timestamp, pid bigint, ppid bigint, "
                   "comm string, cmdline string")


def read_process_snapshots(spark: SparkSession, path: str, streaming: bool = False,
                           per_batch: int | None = None) -> DataFrame:
    """Process snapshots from Parquet; a stream takes ``per_batch`` files at a time."""
    reader = (spark.readStream if streaming else spark.read).schema(SNAPSHOT_SCHEMA)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def write_process_snapshots(procs: DataFrame, path: str) -> None:
    names = [c.split()[0] for c in SNAPSHOT_SCHEMA.split(", ")]
    procs.select(names).write.mode("append").parquet(path)


def numeric_entries(entries: DataFrame, name: str = "entry") -> DataFrame:
    """One row per numeric process-directory entry, its name as ``pid``; others are dropped."""
    pid = F.when(F.col(name).rlike(r"^\+?[0-9]+\z"), F.col(name).try_cast("bigint"))
    return (entries.withColumn("pid", F.when(pid < 4294967296, pid))
            .filter(F.col("pid").isNotNull()).drop(name))
