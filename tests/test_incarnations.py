"""Processes whose pids are given away, against a walk at the time of every event."""

import random
from datetime import datetime, timedelta

import pytest

from veilwatch.operators.incarnations import _meeting, incarnations, recorded_facts
from veilwatch.operators.lineage import asof_snapshot
from veilwatch.plans.dispatch import agent_executions

T0 = datetime(2024, 3, 1)
LOG = "event_id long, host string, ts timestamp, pid long, ppid long"
PROCS = "host string, snapshot_ts timestamp, pid long, ppid long, comm string, cmdline string"


def tables(seed: int):
    rng = random.Random(seed)
    procs, log = [], []
    for host in "ab":
        for k in range(4):
            for pid in rng.sample(range(2, 30), 12):
                procs.append((host, T0 + timedelta(hours=6 * k), pid, rng.randrange(0, 30),
                              "claude" if rng.random() < 0.15 else "sh", "x"))
        for _ in range(500):
            at = timedelta(minutes=rng.randrange(-60, 24 * 60), seconds=rng.choice([0, 0, 30]))
            log.append((len(log), host, T0 + at, rng.randrange(1, 30), rng.choice([None, *range(30)])))
    return procs, log


def walk(procs, log, listed_stay):
    out = set()
    for event, host, ts, pid, _ in log:
        snaps = [s for h, s, *_ in procs if h == host and s <= ts]
        if not snaps:
            continue
        at = max(snaps)
        listed = {p[2]: p for p in procs if p[:2] == (host, at)}

        def process(pid):
            """Parent and root mark of the process that holds a pid at the time of the event."""
            now = (listed[pid][3], listed[pid][4] == "claude") if pid in listed else None
            if now and listed_stay:
                return now
            times = sorted({t for _, h, t, p, q in log if h == host and p == pid and at <= t <= ts and q is not None})
            for t in times:
                parent = min(q for _, h, u, p, q in log if h == host and p == pid and u == t and q is not None)
                if now is None or now[0] != parent:
                    now = (parent, False)
            return now

        current = pid
        for _ in range(32):
            now = process(current)
            if now is None:
                break
            if now[1]:
                out.add(event)
                break
            if current <= 1 or now[0] == current:
                break
            current = now[0]
    return out


@pytest.mark.parametrize("seed, listed_stay", [(1, True), (2, False), (3, False)])
def test_events_of_agents_equal_a_walk(spark, seed, listed_stay):
    procs, log = tables(seed)
    found = agent_executions(spark.createDataFrame(log, LOG), spark.createDataFrame(procs, PROCS),
                             listed_stay=listed_stay)
    got = [r["event_id"] for r in found.collect()]
    assert sorted(got) == sorted(walk(procs, log, listed_stay)) and got


def test_a_later_execution_says_nothing_of_an_earlier_event(spark):
    procs = spark.createDataFrame([("h", T0, 10, 1, "claude", "x")], PROCS)
    at = [T0 + timedelta(seconds=k) for k in range(6)]
    log = spark.createDataFrame([(0, "h", at[0], 30, 20), (1, "h", at[1], 20, 10), (2, "h", at[2], 30, 20),
                                 (3, "h", at[3], 20, 1), (4, "h", at[4], 30, 20), (5, "h", at[5], 30, 10)], LOG)
    assert sorted(r["event_id"] for r in agent_executions(log, procs).collect()) == [1, 2, 5]


def test_a_busy_pid_is_one_process(spark):
    """A pid that runs program after program is one interval, whatever share of the log it has."""
    procs = spark.createDataFrame([("h", T0, 10, 1, "claude", "x")], PROCS)
    log = spark.range(20_000).selectExpr(
        "id AS event_id", "'h' AS host", "timestamp'2024-03-01 00:00:01' + make_dt_interval(0, 0, 0, id) AS ts",
        "if(id % 3 = 0, id, 7) AS pid", "if(id = 10000, 12L, 10L) AS ppid")
    lives = incarnations(recorded_facts(asof_snapshot(log, procs), procs)).filter("pid = 7").collect()
    assert len(lives) == 3
    assert agent_executions(log, procs).count() == 20_000 - 1


def test_meeting_intervals_are_not_all_pairs(spark):
    """Two pids with thousands of intervals each: what is joined grows with them, not with their square."""
    n = 3000
    made = lambda pid, up, step: (
        f"'h' AS host, timestamp'2024-03-01' AS snapshot_ts, {pid} AS pid, {up} AS up, "
        f"timestamp_seconds(id * 2 + {step}) AS since, timestamp_seconds(id * 2 + 2 + {step}) AS until")
    below = spark.range(n).selectExpr(*made("7L", "8L", 0).split(", "))
    above = spark.range(n).selectExpr(*made("7L", "8L", 1).split(", ")).drop("pid").withColumnsRenamed(
        {"since": "_since", "until": "_until"})
    met = _meeting(below, above)
    joined = met.select("since", "_since").collect()
    assert len(joined) == 2 * n - 1 and len(set(joined)) == len(joined)
