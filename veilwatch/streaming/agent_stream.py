"""The audit of agent processes as a stream that keeps its lineage between batches.

Executions and process snapshots arrive on two sources and meet in one micro-batch.  Kept per host are:
the snapshots from the last one before the host's close on, the executions since then (narrow), and the
watched commands that still wait.  A command waits until a snapshot says that no older one is to come:
it is judged once the host's close has passed it, by the snapshot before it and by the executions up to
its time, as the batch audit does.  What a batch reads is its own rows and the kept rows of its hosts;
neither grows with the history.

The close of a host is its newest snapshot less ``lateness`` and never goes back.  An execution or a
snapshot that arrives behind the close is dropped: it is a replay, or later than promised.  So a batch
that runs again, a restart and a new checkpoint report nothing twice.  ``finish_agent_audit`` judges what
still waits when a log has ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwatch.functions.text import basename
from veilwatch.operators.joins import salted_join
from veilwatch.operators.lineage import asof_snapshot, flag_roots
from veilwatch.plans.dispatch import Context, audit, of_agents
from veilwatch.plans.reports import build_reports
from veilwatch.rules.registry import WATCHED
from veilwatch.session import cut_lineage
from veilwatch.sources.reports import CADENCE, stream_id, write_reports
from veilwatch.streaming.kept_state import BUCKETS, KeptState

#: How much later than a newer snapshot of its host an execution or a snapshot may arrive.
LATENESS = "10 minutes"
CLOSE, PROCESS, RAN = "close", "process", "ran"


def _schema(cmds: DataFrame) -> T.StructType:
    """One form for all kept rows; ``cmd`` is a watched command that waits."""
    return T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("host", T.StringType()),
        T.StructField("at", T.TimestampType()), T.StructField("pid", T.LongType()),
        T.StructField("ppid", T.LongType()), T.StructField("is_root", T.BooleanType()),
        T.StructField("event_id", T.LongType()), T.StructField("cmd", T.StructType(cmds.schema.fields))])


def arrivals(cmds: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Executions and snapshot rows in the form of the kept ones; programs nobody watches stay narrow."""
    schema = _schema(cmds)
    name = F.col("basename") if "basename" in cmds.columns else basename(F.col("filename"))
    ran = cmds.select(F.lit(RAN).alias("kind"), "host", F.col("ts").alias("at"), "pid", "ppid",
                      F.lit(None).cast("boolean").alias("is_root"), "event_id",
                      F.when(name.isin(WATCHED), F.struct(*cmds.columns)).alias("cmd"))
    seen = flag_roots(snapshots).select(
        F.lit(PROCESS).alias("kind"), "host", F.col("snapshot_ts").alias("at"), "pid", "ppid", "is_root",
        F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast(schema["cmd"].dataType).alias("cmd"))
    return ran.unionByName(seen)


class AgentAudit:
    """One step per micro-batch: what is due is judged and reported, the rest is kept."""

    def __init__(self, spark: SparkSession, cmds: DataFrame, context: Callable[[], Context], path: str,
                 state: str, lateness: str = LATENESS, buckets: int = BUCKETS):
        self.spark, self.context, self.path, self.lateness = spark, context, path, lateness
        self.schema = _schema(cmds)
        self.state = KeptState(spark, state, self.schema, buckets)

    def step(self, batch: DataFrame, stream: str, number: int, ended: bool = False) -> None:
        before = self.state.before(stream, number)
        batch = cut_lineage(batch)
        bucket = self.state.bucket("host")
        touched = None if ended else [r[0] for r in batch.select(bucket).distinct().collect()]
        if touched == []:
            return
        kept = self.state.read(before, touched)
        shut = kept.filter(F.col("kind") == CLOSE).select("host", F.col("at").alias("shut"))
        fresh = self._with_host(batch, shut).filter("shut is null or at >= shut").drop("shut")
        rows = cut_lineage(kept.filter(F.col("kind") != CLOSE).unionByName(fresh).dropDuplicates(
            ["kind", "host", "at", "pid", "ppid", "event_id"]))
        closes = cut_lineage(self._closes(rows, shut, ended))
        rows = self._with_host(rows, closes)
        due = rows.filter("at < close and cmd is not null and (shut is null or at >= shut)")
        if not due.isEmpty():
            write_reports(build_reports(self._judged(rows, due)), self.path, f"{stream}-{number}")
        last = rows.filter((F.col("kind") == PROCESS) & (F.col("at") <= F.col("close"))).groupBy("host").agg(
            F.max("at").alias("base"))
        left = self._with_host(rows, last).filter("close is null or at >= coalesce(base, close)")
        left = left.withColumn("cmd", F.when(F.col("close").isNull() | (F.col("at") >= F.col("close")), F.col("cmd")))
        marks = closes.filter("close is not null").select(
            F.lit(CLOSE).alias("kind"), "host", F.col("close").alias("at"),
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields[3:]])
        names = self.schema.fieldNames()
        self.state.publish(left.select(names).unionByName(marks), "host",
                           list(range(self.state.buckets)) if ended else touched, before, stream, number)

    def _with_host(self, rows: DataFrame, facts: DataFrame) -> DataFrame:
        """Facts of a host, one row each, beside all its rows; a host with most rows is spread."""
        return salted_join(rows, facts, ["host"], "left", ["at", "pid"])

    def _closes(self, rows: DataFrame, shut: DataFrame, ended: bool) -> DataFrame:
        """Per host ``shut`` (its close so far) and ``close``, which never goes back."""
        newest = F.max(F.when(F.col("kind") == PROCESS, F.col("at"))) - F.expr(f"interval {self.lateness}")
        if ended:
            newest = F.max("at") + F.expr("interval 1 microsecond")
        hosts = rows.groupBy("host").agg(newest.alias("newest"))
        return hosts.join(shut, "host", "full").select(
            "host", "shut", F.greatest("shut", "newest").alias("close"))

    def _judged(self, rows: DataFrame, due: DataFrame) -> DataFrame:
        ctx = self.context()
        ran = rows.filter((F.col("kind") == RAN) & F.expr("at < close")).select(
            "event_id", "host", F.col("at").alias("ts"), "pid", "ppid")
        procs = rows.filter(F.col("kind") == PROCESS).select(
            "host", F.col("at").alias("snapshot_ts"), "pid", "ppid", "is_root")
        placed = cut_lineage(asof_snapshot(ran, procs, salts=ctx.salts))
        ours = of_agents(placed, procs, ctx.salts)
        return audit(due.select("cmd.*").join(ours, "event_id"), ctx)


def stream_agent_audit(cmds: DataFrame, snapshots: DataFrame, context: Callable[[], Context], path: str,
                       state: str, checkpoint: str, trigger: dict = CADENCE, lateness: str = LATENESS,
                       buckets: int = BUCKETS):
    """Reports on commands of agent processes, from a stream of executions and one of snapshots.

    ``state`` is a folder of its own, which outlives checkpoints.
    """
    own = AgentAudit(cmds.sparkSession, cmds, context, path, state, lateness, buckets)
    return (arrivals(cmds, snapshots).writeStream
            .foreachBatch(lambda batch, number: own.step(batch, stream_id(batch), number))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def finish_agent_audit(spark: SparkSession, cmds: DataFrame, context: Callable[[], Context], path: str,
                       state: str, buckets: int = BUCKETS) -> None:
    """Judge what still waits, with the snapshots there are: the log has ended.  ``cmds`` gives the columns."""
    own = AgentAudit(spark, cmds, context, path, state, buckets=buckets)
    version = own.state.before("", -1)["version"]
    own.step(spark.createDataFrame([], own.schema), f"ended-{version}", 0, ended=True)
