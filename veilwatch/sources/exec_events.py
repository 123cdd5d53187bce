"""Execution events and command log: batch and stream sources, fixed-width record decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwatch.functions.text import basename
from veilwatch.rules.registry import WATCHED

EXEC_EVENT_SCHEMA = ("host string, ts timestamp, pid bigint, uid bigint, "
                     "comm binary, filename binary")
FRAME_SCHEMA = "host string, ts timestamp, raw binary"
COMMAND_LOG_SCHEMA = ("event_id bigint, host string, ts timestamp, pid bigint, ppid bigint, uid bigint, "
                      "comm string, filename string, basename string, cmdline binary, cwd string, day date")

# Layout of a raw record.
FRAME_BYTES = 280
PID_AT, UID_AT, COMM_AT, FILENAME_AT = 0, 4, 8, 24
COMM_BYTES, FILENAME_BYTES = 16, 256


def _read(spark: SparkSession, path: str, schema: str, streaming: bool, per_batch: int | None):
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def read_exec_events(spark: SparkSession, path: str, streaming: bool = False,
                     raw: bool = False, per_batch: int | None = None) -> DataFrame:
    """Execution events from Parquet; ``raw`` reads undecoded frames and drops short ones."""
    if raw:
        return decode_frames(_read(spark, path, FRAME_SCHEMA, streaming, per_batch))
    return _read(spark, path, EXEC_EVENT_SCHEMA, streaming, per_batch)


def read_command_log(spark: SparkSession, path: str, streaming: bool = False,
                     per_batch: int | None = None) -> DataFrame:
    """The command log as ``write_command_log`` stores it, by day and with the program's name."""
    return _read(spark, path, COMMAND_LOG_SCHEMA, streaming, per_batch)


def write_command_log(log: DataFrame, path: str) -> None:
    """Append to the stored log: a folder per day, the program's name beside its path."""
    stored = log.withColumns({"basename": basename(F.col("filename")), "day": F.to_date("ts")})
    names = [c.split()[0] for c in COMMAND_LOG_SCHEMA.split(", ")]
    (stored.select(names).hint("rebalance", "day")
     .write.partitionBy("day").mode("append").parquet(path))


def _little_endian(raw: Column, at: int) -> Column:
    pairs = [F.hex(F.substring(raw, at + k, 1)) for k in range(4, 0, -1)]
    return F.conv(F.concat(*pairs), 16, 10).cast("bigint")


def c_text(raw: Column) -> Column:
    """Bytes up to the first NUL as text; invalid UTF-8 gives an empty string."""
    text = F.substring_index(raw.cast("string"), "\u0000", 1)
    return F.when(raw.isNotNull(), F.coalesce(F.try_validate_utf8(text), F.lit("")))


def decode_frames(frames: DataFrame) -> DataFrame:
    """Split raw records into fields; records shorter than the layout are dropped."""
    raw = F.col("raw")
    return (frames.filter(F.length(raw) >= FRAME_BYTES)
            .withColumns({
                "pid": _little_endian(raw, PID_AT),
                "uid": _little_endian(raw, UID_AT),
                "comm": F.substring(raw, COMM_AT + 1, COMM_BYTES),
                "filename": F.substring(raw, FILENAME_AT + 1, FILENAME_BYTES)})
            .drop("raw"))


def decode_exec_events(df: DataFrame) -> DataFrame:
    """Binary ``comm`` and ``filename`` to text, with the basename kept for pushdown at ingest."""
    return (df.withColumn("comm", c_text(F.col("comm")))
            .withColumn("filename", c_text(F.col("filename")))
            .withColumn("basename", basename(F.col("filename"))))


def watchlist_filter(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Keep executions of watched programs.

    On a stored ``basename`` column the test reaches the Parquet scan; otherwise it is computed
    from ``filename`` after the scan.  Both writers, ``write_command_log`` and ``decode_exec_events``,
    fill the column on every row.
    """
    name = F.col("basename") if "basename" in df.columns else basename(F.col("filename"))
    return df.filter(name.isin(WATCHED if names is None else names))
