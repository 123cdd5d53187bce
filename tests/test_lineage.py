"""Lineage against a plain walk, snapshots against brute force."""

import random
from datetime import datetime, timedelta

from veilwatch.plans.dispatch import agent_executions
from veilwatch.operators.lineage import (agent_events, asof_snapshot, descendants, flag_roots,
                                         root_changes, root_set_changes)

T0 = datetime(2024, 3, 1)


def _walk(pid, parents, roots):
    current = pid
    for _ in range(32):
        if current in roots:
            return True
        if current <= 1 or current not in parents or parents[current] == current:
            return False
        current = parents[current]
    return False


def test_descendants_equal_a_walk(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for host in ("a", "b"):
        for hour in range(3):
            ts = T0 + timedelta(hours=hour)
            pids = rng.sample(range(1, 400), 300)
            parents = {p: rng.choice(pids + [p, 0, 999]) for p in pids}
            chain = list(range(1000, 1060))
            parents.update({p: p - 1 for p in chain[1:]} | {1000: 1000})
            roots = set(rng.sample(pids, 5)) | {1005}
            rows += [(host, ts, p, q, "claude" if p in roots else "sh", "x") for p, q in parents.items()]
            want |= {(host, ts, p) for p in parents if _walk(p, parents, roots)}
    procs = spark.createDataFrame(rows, "host string, snapshot_ts timestamp, pid long, ppid long, "
                                        "comm string, cmdline string")
    roots = flag_roots(procs).filter("is_root")
    got = {(r["host"], r["snapshot_ts"], r["pid"]) for r in descendants(procs, roots).collect()}
    assert got == want
    assert ("a", T0, 1005 + 31) in got and ("a", T0, 1005 + 32) not in got


def test_root_words(spark):
    rows = [(" Claude-x\n", "", True, False), ("claude", None, True, True), ("sh", "node /CLAUDE/x", True, False),
            ("sh", "claude by anthropic", True, True), (None, "vim", False, False), ("xclaude", "", False, False)]
    df = spark.createDataFrame(rows, "comm string, cmdline string, loose boolean, strict boolean")
    for r in flag_roots(df).collect():
        assert r["is_root"] == r["loose"], r
    for r in flag_roots(df, strict=True).collect():
        assert r["is_root"] == r["strict"], r


def test_asof_equals_brute_force(spark):
    rng = random.Random(5)
    snaps = [(h, T0 + timedelta(seconds=rng.randint(0, 400_000))) for h in "ab" for _ in range(60)]
    events = [(i, rng.choice("abc"), T0 + timedelta(seconds=rng.randint(-5000, 500_000)), 1) for i in range(800)]
    events += [(1000 + i, h, t, 1) for i, (h, t) in enumerate(snaps[:20])]
    s = spark.createDataFrame(snaps, "host string, snapshot_ts timestamp")
    e = spark.createDataFrame(events, "event_id long, host string, ts timestamp, pid long")
    got = {r["event_id"]: (r["snapshot_ts"], r["stale"]) for r in asof_snapshot(e, s).collect()}
    assert len(got) == len(events)
    for i, host, ts, _ in events:
        best = max((t for h, t in snaps if h == host and t <= ts), default=None)
        stale = None if best is None else (ts - best) > timedelta(seconds=5)
        assert got[i] == (best, stale)


def test_changes_equal_sets_and_count_empty_snapshots(spark):
    rng = random.Random(9)
    procs, sets = [], {}
    for host in "ab":
        for k in range(40):
            ts = T0 + timedelta(hours=7 * k)
            roots = set() if k % 9 == 4 else set(rng.sample(range(10, 16), rng.randint(1, 3)))
            if k % 5 == 3:
                roots = sets[host, k - 1]
            sets[host, k] = roots
            procs += [(host, ts, p, 1, "claude" if p in roots else "sh", "") for p in range(10, 18)]
    df = spark.createDataFrame(procs, "host string, snapshot_ts timestamp, pid long, ppid long, "
                                      "comm string, cmdline string")
    roots = flag_roots(df).filter("is_root").select("host", "snapshot_ts", "pid")
    got = {(r["host"], r["snapshot_ts"], r["pid"], r["change"]) for r in root_changes(df, roots).collect()}
    want, logged = set(), set()
    for host in "ab":
        logged.add((host, T0, len(sets[host, 0])))
        for k in range(1, 40):
            ts, new, old = T0 + timedelta(hours=7 * k), sets[host, k], sets[host, k - 1]
            want |= {(host, ts, p, "added") for p in new - old} | {(host, ts, p, "removed") for p in old - new}
            if new != old:
                logged.add((host, ts, len(new)))
    assert got == want
    rows = root_set_changes(df, roots).collect()
    assert {(r["host"], r["snapshot_ts"], r["n_roots"]) for r in rows} == logged


def test_one_busy_pid_is_kept_whole(spark):
    events = spark.range(3000).selectExpr("id AS event_id", "'h' AS host", "timestamp'2024-03-01' AS snapshot_ts",
                                          "IF(id % 3 = 0, 7, id + 100) AS pid")
    closure = spark.createDataFrame([("h", T0, 7), ("h", T0, 101)], "host string, snapshot_ts timestamp, pid long")
    assert agent_events(events, closure).count() == 1001


def test_young_processes_belong_to_their_agent(spark):
    """A chain of executions below a root of the snapshot, the 32-node bound over both sources."""
    procs = spark.createDataFrame([("h", T0, 10, 1, "claude", "x"), ("h", T0, 11, 10, "sh", "x"), ("h", T0, 50, 1, "sh", "x"),
                                   ("g", T0, 10, 1, "sh", "x")],
                                  "host string, snapshot_ts timestamp, pid long, ppid long, comm string, cmdline string")
    rows = [(k, "h", T0 + timedelta(seconds=k), 100 + k, 11 if k == 0 else 99 + k) for k in range(40)]
    rows += [(1000, "h", T0 + timedelta(seconds=3), 300, 50), (1001, "g", T0 + timedelta(seconds=3), 300, 10),
             (1002, "h", T0 - timedelta(seconds=3), 301, 10), (1003, "h", T0 + timedelta(days=300), 11, 10),
             (1004, "h", T0 + timedelta(seconds=9), 302, None)]
    log = spark.createDataFrame(rows, "event_id long, host string, ts timestamp, pid long, ppid long")
    got = {r["event_id"]: r["stale"] for r in agent_executions(log, procs).collect()}
    # 10, 11 and thirty executions are thirty-two nodes
    assert set(got) == set(range(30)) | {1003}
    assert got[0] is False and got[5] is False and got[6] is True and got[1003] is True
