"""Report sink: a folder per calendar day, below it one per batch.

A named batch that runs again replaces what it wrote, on every day it wrote to, so a replay reports
nothing twice; without a name every call appends.  Names must differ between streams and checkpoints:
``stream_reports`` names a batch by the stream's id and its number.  A day is read without listing the
others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How often streams look for new rows, unless told otherwise.
CADENCE = {"processingTime": "5 seconds"}


def write_reports(reports: DataFrame, path: str, batch: str | None = None) -> None:
    """Write the reports of one batch.  The rebalance gives few files per day and splits a day that holds
    much of the data over several."""
    if batch:
        forget_reports(reports.sparkSession, path, batch)
    (reports.withColumn("batch_id", F.lit(f"b{batch or uuid.uuid4().hex}")).hint("rebalance", "report_date")
     .write.partitionBy("report_date", "batch_id").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def forget_reports(spark, path: str, batch: str) -> None:
    """Remove what an earlier run of the batch wrote; its new run may yield nothing for a day."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/report_date=*/batch_id=b{batch}")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(pattern) or []:
        fs.delete(found.getPath(), True)


def stream_id(batch: DataFrame) -> str:
    """The id of the running stream: the same after a restart, another with a new checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def stream_reports(reports: DataFrame, path: str, checkpoint: str, trigger: dict = CADENCE):
    """Write a stream of reports, a batch at a time."""
    return (reports.writeStream.foreachBatch(
        lambda df, n: write_reports(df, path, f"{stream_id(df)}-{n}"))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())
