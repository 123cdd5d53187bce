"""The audit as a stream over newly arriving commands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwatch.operators.lineage import flag_roots
from veilwatch.plans.dispatch import Context, agent_executions, audit
from veilwatch.plans.reports import build_reports
from veilwatch.session import cut_lineage, written
from veilwatch.sources.exec_events import watchlist_filter
from veilwatch.sources.reports import CADENCE, forget_reports, stream_id, stream_reports, write_reports
from veilwatch.streaming.kept_state import KeptState

#: How late an execution may arrive and still be told from a replay; later ones are dropped.
LATENESS = "1 hour"
#: How late a snapshot may arrive and still be put between its neighbours.
KEPT = "1 day"

_SETS = "host string, snapshot_ts timestamp, pids array<bigint>"
_CHANGES = "host string, snapshot_ts timestamp, pid bigint, change string, batch_id bigint"


def without_replays(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drop executions that were delivered before."""
    return (events.withWatermark("ts", lateness)
            .dropDuplicatesWithinWatermark(["host", "pid", "ts", "filename"]))


def stream_verdicts(cmds: DataFrame, ctx: Context) -> DataFrame:
    """Verdicts of all commands that need nothing but their own row: a stateless streaming plan with the
    rules compiled in.  SQL files and commits need a lookup and are left to ``stream_audit``."""
    return audit(cmds, ctx, lookups=False)


def stream_reports_of(cmds: DataFrame, ctx: Context, path: str, checkpoint: str,
                      trigger: dict = CADENCE, lateness: str = LATENESS):
    """Reports of ``stream_verdicts`` in the sink, each execution once."""
    verdicts = stream_verdicts(without_replays(cmds, lateness), ctx)
    return stream_reports(build_reports(verdicts), path, checkpoint, trigger)


def stream_audit(cmds: DataFrame, context: Callable[[], Context], path: str, checkpoint: str,
                 snapshots: Callable[[], DataFrame] | None = None,
                 log: Callable[[], DataFrame] | None = None,
                 trigger: dict = CADENCE, lateness: str = LATENESS):
    """All guards on a stream; with ``snapshots`` only commands of agent processes.

    Lookups of files and diffs and the joins over process snapshots run in the batch function, which
    reads their state anew for every micro-batch.  ``log`` gives the stored executions, from which
    processes younger than their snapshot are known; without it those of the batch are.  Of these and of
    the snapshots a batch takes the time its own commands depend on (``_span``), and nothing where all its
    commands are replays or nobody watches them.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        name = f"{stream_id(batch)}-{batch_id}"
        if snapshots:
            ours = written(batch if log is None else watchlist_filter(batch))
            span = _span(watchlist_filter(ours), snapshots())
            if span is None:
                return forget_reports(batch.sparkSession, path, name)
            known = (log() if log else ours).filter(F.col("ts").between(*span))
            procs = snapshots().filter(F.col("snapshot_ts").between(*span))
            agents = agent_executions(known.dropDuplicates(["event_id"]) if log else known, procs, context().salts)
            batch = watchlist_filter(ours).join(agents, "event_id")
        write_reports(build_reports(audit(batch, context())), path, name)

    return (without_replays(cmds, lateness).writeStream.foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def _span(cmds: DataFrame, snapshots: DataFrame) -> tuple[Column, Column] | None:
    """From the earliest snapshot that a command refers to, up to the last command; none where no command
    has a snapshot.

    An execution that is later than a command says nothing about it, nor does one before the last snapshot
    of its host, as identities never reach over a snapshot.
    """
    hosts = cmds.groupBy("host").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    # the last snapshot at or before the host's first command, else the first one behind it
    before = F.max(F.when(F.col("snapshot_ts") <= F.col("first"), F.col("snapshot_ts")))
    times = snapshots.select("host", "snapshot_ts").distinct().join(hosts, "host").filter(
        F.col("snapshot_ts") <= F.col("last"))
    each = times.groupBy("host").agg(F.coalesce(before, F.min("snapshot_ts")).alias("since"), F.max("last").alias("until"))
    found = each.agg(F.unix_micros(F.min("since")), F.unix_micros(F.max("until"))).first()
    return None if found[0] is None else tuple(F.timestamp_micros(F.lit(t)) for t in found)


def stream_root_changes(snapshots: DataFrame, path: str, checkpoint: str, trigger: dict = CADENCE,
                        kept: str = KEPT):
    """Root changes per micro-batch of snapshots; read them by ``read_root_changes``.

    The state is a small table, the root sets of the last ``kept`` of time per host, of which a batch
    reads and writes its hosts' buckets.  A snapshot that arrives late is put between its neighbours, and
    the changes of the snapshot after it are said again; a snapshot that comes twice changes nothing.
    Batches are numbered by the state's versions, so a stream with a new checkpoint goes on after the
    last one and overwrites nothing.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        state = KeptState(batch.sparkSession, f"{path}/state", T.StructType.fromDDL(_SETS))
        stream = stream_id(batch)
        before = state.before(stream, batch_id)
        root = F.when(F.col("is_root"), F.col("pid"))
        fresh = cut_lineage(flag_roots(batch).groupBy("host", "snapshot_ts")
                            .agg(F.array_sort(F.collect_set(root)).alias("pids"))).withColumn("fresh", F.lit(True))
        touched = [r[0] for r in fresh.select(state.bucket("host")).distinct().collect()]
        known = fresh.unionByName(state.read(before, touched).withColumn("fresh", F.lit(False)))
        known = cut_lineage(known.groupBy("host", "snapshot_ts").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("pids")))).alias("pids"),
            F.max("fresh").alias("fresh")))
        newest = known.groupBy("host").agg(F.max("snapshot_ts").alias("newest"))
        recent = known.join(newest, "host").filter(F.col("snapshot_ts") >= F.expr(f"newest - interval {kept}"))
        order = Window.partitionBy("host").orderBy("snapshot_ts")  # a host's snapshots within ``kept``
        steps = known.withColumns({"before": F.lag("pids").over(order), "moved": F.lag("fresh").over(order)})
        steps = steps.filter(F.col("fresh") | F.col("moved"))
        said = F.concat(
            F.array(F.struct(F.lit(None).cast("bigint").alias("pid"), F.lit("seen").alias("change"))),
            _changed("pids", "before", "added"), _changed("before", "pids", "removed"))
        (steps.select("host", "snapshot_ts", F.explode(said).alias("c"))
         .select("host", "snapshot_ts", "c.pid", "c.change")
         .write.mode("overwrite").parquet(f"{path}/changes/batch_id={before['version'] + 1}"))
        state.publish(recent, "host", touched, before, stream, batch_id)

    return (snapshots.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def _changed(ours: str, theirs: str, word: str):
    """Pids in one set and not in the other; none for a host's first snapshot."""
    pids = F.when(F.col("before").isNotNull(), F.array_except(ours, theirs)).otherwise(
        F.array().cast("array<bigint>"))
    return F.transform(pids, lambda p: F.struct(p.alias("pid"), F.lit(word).alias("change")))


def read_root_changes(spark: SparkSession, path: str) -> DataFrame:
    """The changes of every snapshot as its last batch said them."""
    said = spark.read.schema(_CHANGES).parquet(f"{path}/changes")
    last = said.groupBy("host", "snapshot_ts").agg(F.max("batch_id").alias("batch_id"))
    return (said.join(last, ["host", "snapshot_ts", "batch_id"], "left_semi")
            .filter("change <> 'seen'").drop("batch_id"))
