"""The audit stream that keeps its lineage: reports once, bounded state, reruns and new checkpoints."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veilwatch.plans.dispatch import Context, audit_commands
from veilwatch.plans.reports import build_reports
from veilwatch.sources.reports import write_reports
from veilwatch.sources.snapshots import read_process_snapshots, write_process_snapshots
from veilwatch.streaming import audit_stream
from veilwatch.streaming.audit_stream import read_root_changes, stream_audit, stream_root_changes
from veilwatch.streaming.agent_stream import PROCESS, RAN, AgentAudit, arrivals, finish_agent_audit

T0 = datetime(2024, 3, 1)
LOG = "event_id long, host string, ts timestamp, pid long, ppid long, filename string, argv array<string>, cwd string"
PROCS = "host string, snapshot_ts timestamp, pid long, ppid long, comm string, cmdline string"
BAD = ["docker", "run", "--privileged", "x"]


def rows(hours):
    """Per hour a snapshot with one agent, its child and another process; commands half an hour later."""
    procs, log = [], []
    for h in hours:
        at = T0 + timedelta(hours=h)
        procs += [("h", at, 10 + h, 1, "claude", "x"), ("h", at, 500, 10 + h, "sh", "x"), ("h", at, 600, 1, "sh", "x")]
        late = at + timedelta(minutes=30)
        log += [(10 * h + k, "h", late + timedelta(seconds=k), pid, ppid, f"/usr/bin/{argv[0]}", argv, "/w")
                for k, (pid, ppid, argv) in enumerate([(700, 500, ["sh"]), (701, 700, BAD), (702, 600, BAD), (500, 1, BAD)])]
    return procs, log


def reported(spark, path):
    return sorted(r["event_id"] for r in spark.read.parquet(path).select("event_id").collect())


def test_reports_once_and_state_is_bounded(spark, tmp_path):
    path, state = str(tmp_path / "reports"), str(tmp_path / "state")
    contents = spark.createDataFrame([], "host string, path string, recorded_at timestamp, content string")
    diffs = spark.createDataFrame([], "event_id long, recorded_at timestamp, files array<string>, diff string, error string")
    ctx = lambda: Context(contents, diffs)
    cmds = spark.createDataFrame([], LOG)
    own = AgentAudit(spark, cmds, ctx, path, state, "0 seconds", buckets=4)

    def batch(log_hours, proc_hours):
        return arrivals(spark.createDataFrame(rows(log_hours)[1], LOG), spark.createDataFrame(rows(proc_hours)[0], PROCS))

    sizes = []
    for n in range(4):  # snapshots come a batch late
        given = batch([n], [n - 1] if n else [])
        own.step(given, "one", n)
        if n == 2:  # the same batch again, as after a failure before its commit
            own.step(given, "one", n)
        kept = own.state.read(own.state.before("", -1))
        sizes.append((kept.filter(F.col("kind") == PROCESS).count(), kept.filter(F.col("kind") == RAN).count()))
        assert n < 2 or reported(spark, path) == [10 * h + k for h in range(n - 1) for k in (1, 3)]
    assert sizes[2] == sizes[3] and sizes[3][0] <= 3 and sizes[3][1] <= 12
    own.step(batch(range(3), range(2)), "two", 0)  # a new checkpoint reads all files again
    finish_agent_audit(spark, cmds, ctx, path, state, buckets=4)
    finish_agent_audit(spark, cmds, ctx, path, state, buckets=4)
    procs, log = rows(range(4))
    procs = [p for p in procs if p[1] < T0 + timedelta(hours=3)]
    want = build_reports(audit_commands(spark.createDataFrame(log, LOG), spark.createDataFrame(procs, PROCS), ctx()))
    assert reported(spark, path) == sorted(r["event_id"] for r in want.select("event_id").collect()) != []
    folders = {p.name for p in (tmp_path / "state" / "rows").iterdir()}
    named = {f for m in (tmp_path / "state" / "manifest").iterdir() if m.name.isdigit()
             for f in json.loads(m.read_text())["folders"].values()}
    assert folders == named


def test_streams_share_a_report_path(spark, tmp_path):
    path = str(tmp_path / "reports")
    day = spark.createDataFrame([(1, T0), (2, T0 + timedelta(days=1))], "event_id long, ts timestamp").withColumn(
        "report_date", F.to_date("ts"))
    write_reports(day, path, "a-0")
    write_reports(day, path, "b-0")
    assert spark.read.parquet(path).count() == 4
    write_reports(day.filter("event_id = 1"), path, "a-0")  # the rerun yields nothing for the second day
    assert sorted(r["event_id"] for r in spark.read.parquet(path).collect()) == [1, 1, 2]


def test_root_changes_go_on_with_a_new_checkpoint(spark, tmp_path):
    snaps, path = str(tmp_path / "snaps"), str(tmp_path / "changes")

    def run(checkpoint):
        found = read_process_snapshots(spark, snaps, streaming=True, per_batch=1)
        stream_root_changes(found, path, str(tmp_path / checkpoint), {"availableNow": True}, "30 days").awaitTermination()
        return sorted((r["snapshot_ts"].hour, r["pid"], r["change"]) for r in read_root_changes(spark, path).collect())

    for hours in ([0], [2], [1]):  # the second snapshot comes last
        write_process_snapshots(spark.createDataFrame(rows(hours)[0], PROCS).coalesce(1), snaps)
    want = [(h, pid, change) for h in (1, 2) for pid, change in ((10 + h, "added"), (9 + h, "removed"))]
    assert run("one") == sorted(want)
    write_process_snapshots(spark.createDataFrame(rows([3])[0], PROCS).coalesce(1), snaps)
    assert run("two") == sorted([*want, (3, 13, "added"), (3, 12, "removed")])
    assert len(list((tmp_path / "changes" / "state" / "rows").iterdir())) <= 2


def test_a_batch_takes_only_its_own_time_of_the_log(spark, tmp_path, monkeypatch):
    """Hours in batches of their own, the last one a replay: none works through the whole log again."""
    path, log = str(tmp_path / "reports"), str(tmp_path / "log")
    contents = spark.createDataFrame([], "host string, path string, recorded_at timestamp, content string")
    diffs = spark.createDataFrame([], "event_id long, recorded_at timestamp, files array<string>, diff string, error string")
    ctx = lambda: Context(contents, diffs)
    procs = spark.createDataFrame(rows(range(3))[0], PROCS)
    for hour in (1, 2, 1):
        spark.createDataFrame(rows([hour])[1], LOG).coalesce(1).write.mode("append").parquet(log)
    seen = []

    def spied(known, snapshots, salts):
        hours = lambda df, time: {r[0].hour for r in df.select(time).distinct().collect()}
        seen.append((hours(known, "ts"), hours(snapshots, "snapshot_ts")))
        return real(known, snapshots, salts)

    real = audit_stream.agent_executions
    monkeypatch.setattr(audit_stream, "agent_executions", spied)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(log)
    stream_audit(stream, ctx, path, str(tmp_path / "state"), lambda: procs, lambda: spark.read.schema(LOG).parquet(log),
                 {"availableNow": True}, "30 days").awaitTermination()
    assert seen == [({1}, {1}), ({2}, {2})]
    assert reported(spark, path) == [11, 13, 21, 23]
