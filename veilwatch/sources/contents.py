"""File contents and staged diffs as they were when a command ran.

Both are recorded with a time and may be recorded more than once.  A command sees the newest version at or
before its own time, so it has exactly one; a record without a time counts as there from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwatch.functions.argv import names_file
from veilwatch.operators.joins import SALTS, salted_join
from veilwatch.session import cut_lineage

FILE_CONTENTS_SCHEMA = "host string, path string, recorded_at timestamp, content string"
COMMIT_DIFFS_SCHEMA = ("event_id bigint, recorded_at timestamp, files array<string>, diff string, "
                       "error string")
FILE = ["host", "path"]


def read_file_contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_CONTENTS_SCHEMA).parquet(path)


def read_commit_diffs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT_DIFFS_SCHEMA).parquet(path)


def _recorded() -> Column:
    return F.coalesce("recorded_at", F.timestamp_seconds(F.lit(0)))


def newest_versions(wanted: DataFrame, contents: DataFrame, salts: int = SALTS) -> DataFrame:
    """``wanted`` (``event_id, host, path, ts``, small) with ``recorded_at`` of the file's newest version
    at or before ``ts``; commands without one are left out.

    A file's versions are listed per day, with the last one of earlier days, for the days its commands
    ran on; commands join their day, spread over salts where one file is everybody's.
    """
    named = wanted.select(*FILE).distinct()
    day = F.date_trunc("day", "recorded_at")
    days = (contents.select(*FILE, _recorded().alias("recorded_at")).join(named, FILE, "left_semi")
            .groupBy(*FILE, day.alias("_day"))
            .agg(F.array_sort(F.collect_set("recorded_at")).alias("_in")))
    asked = wanted.select(*FILE, F.date_trunc("day", "ts").alias("_day")).distinct().withColumn(
        "_in", F.lit(None).cast("array<timestamp>"))
    by_file = Window.partitionBy(*FILE).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    listed = (days.unionByName(asked).groupBy(*FILE, "_day")
              .agg(F.first("_in", ignorenulls=True).alias("_in"))
              .withColumn("_before", F.last(F.try_element_at("_in", F.lit(-1)), ignorenulls=True)
                          .over(by_file)))
    found = salted_join(wanted.withColumn("_day", F.date_trunc("day", "ts")), listed, [*FILE, "_day"],
                        "inner", ["event_id"], salts)
    within = F.try_element_at(F.filter("_in", lambda t: t <= F.col("ts")), F.lit(-1))
    return (found.withColumn("recorded_at", F.coalesce(within, F.col("_before")))
            .select("event_id", *FILE, "recorded_at").filter(F.col("recorded_at").isNotNull()))


def version_texts(chosen: DataFrame, contents: DataFrame) -> DataFrame:
    """``host, path, recorded_at, content`` of the versions some command saw, one row each."""
    key = [*FILE, "recorded_at"]
    return (contents.withColumn("recorded_at", _recorded())
            .join(chosen.select(*key).distinct(), key, "left_semi")
            .groupBy(*key).agg(F.min("content").alias("content")))


def attach_sql_files(cmds: DataFrame, contents: DataFrame, source: str = "source",
                     out: str = "sql", salts: int = SALTS) -> DataFrame:
    """Add the SQL text of a command: inline text, or the content of its file then (null if unknown).

    Only commands that name a file are joined; the rest of the log is not shuffled.
    """
    kind, value = F.col(source)["kind"], F.col(source)["value"]
    touched = cmds.filter(names_file())
    wanted = cut_lineage(touched.select("event_id", "host", F.when(kind == "file", value).alias("path"), "ts")
                         .filter(F.col("path").isNotNull()).distinct())
    chosen = newest_versions(wanted, contents, salts)
    texts = chosen.join(version_texts(chosen, contents), [*FILE, "recorded_at"]).select(
        "event_id", F.col("content").alias("_content"))
    inline = F.when(kind == "inline", value)
    joined = touched.join(texts, "event_id", "left").withColumn(out, F.coalesce(inline, F.col("_content")))
    return joined.drop("_content").unionByName(cmds.filter(~names_file()).withColumn(out, inline))


def newest_diffs(cmds: DataFrame, diffs: DataFrame) -> DataFrame:
    """The newest diff recorded at or before each command (``event_id, ts``); the diffs of other events
    are left out before anything looks at them."""
    wanted = cmds.select("event_id", "ts").distinct()
    seen = diffs.withColumn("recorded_at", _recorded()).join(wanted, "event_id").filter(
        F.col("recorded_at") <= F.col("ts"))
    best = seen.groupBy("event_id").agg(F.max(F.struct("recorded_at", "diff", "error", "files")).alias("d"))
    return best.select("event_id", "d.files", "d.diff", "d.error")


def attach_diffs(cmds: DataFrame, diffs: DataFrame) -> DataFrame:
    """Left join the staged diffs to commit commands."""
    return cmds.join(newest_diffs(cmds, diffs), "event_id", "left")
