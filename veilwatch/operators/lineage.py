"""Process lineage: roots, bounded closure, root changes, snapshot of an event.

Keys are ``(host, snapshot_ts, pid)``; one host has at most 2**22 processes at one moment, which
bounds every group of one host and one snapshot.  Rows that only share a host are not bounded and are
never put into one task: windows run over the hours of a day or the days of a host.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwatch.operators.joins import SALTS, salted_join
from veilwatch.rules.registry import (AGENT_NAME, MAX_LINEAGE_NODES, ROOT_REFRESH_SECONDS,
                                      STRICT_WORDS)
from veilwatch.functions.text import ascii_lower, trim_ws
from veilwatch.session import cut_lineage

SNAPSHOT = ["host", "snapshot_ts"]


def flag_roots(procs: DataFrame, name: str = AGENT_NAME, strict: bool = False) -> DataFrame:
    """Add ``is_root``: the process belongs to the agent itself.

    By default the trimmed ``comm`` starts with the name or the command line holds it, in any case.
    Strict: ``comm`` equals the name, or the command line holds both words as written.
    """
    comm, line = trim_ws(F.col("comm")), F.col("cmdline")
    if strict:
        words = reduce(lambda a, b: a & b, [F.contains(line, F.lit(w)) for w in STRICT_WORDS])
        test = (comm == STRICT_WORDS[0]) | words
    else:
        test = (ascii_lower(comm).startswith(name)
                | F.contains(ascii_lower(line), F.lit(name)))
    return procs.withColumn("is_root", F.coalesce(test, F.lit(False)))


def root_pids(procs: DataFrame) -> DataFrame:
    """Roots of every snapshot as an ascending list; its length is bounded by the host's processes."""
    return (flag_roots(procs).filter("is_root").groupBy(*SNAPSHOT)
            .agg(F.array_sort(F.collect_set("pid")).alias("pids")))


def process_nodes(procs: DataFrame) -> DataFrame:
    """One node per ``(host, snapshot_ts, pid)``; of several parents given for a pid the smallest counts,
    so rows delivered twice change nothing."""
    return procs.groupBy(*SNAPSHOT, "pid").agg(F.min("ppid").alias("ppid"))


def executed_nodes(placed: DataFrame, procs: DataFrame) -> DataFrame:
    """Nodes for processes younger than their snapshot: executions (``ppid`` and ``snapshot_ts``
    attached) whose pid the snapshot does not hold."""
    seen = procs.select(*SNAPSHOT, "pid").distinct()
    young = placed.filter(F.col("snapshot_ts").isNotNull() & F.col("ppid").isNotNull())
    return process_nodes(young).join(seen, [*SNAPSHOT, "pid"], "left_anti")


def descendants(procs: DataFrame, roots: DataFrame, max_nodes: int = MAX_LINEAGE_NODES,
                young: DataFrame | None = None) -> DataFrame:
    """Pids that are a root or have one among their nearest ``max_nodes - 1`` ancestors.

    ``young`` adds nodes of processes that started after the snapshot (``executed_nodes``).  Pointer
    doubling: after k rounds a row knows whether one of 2**k nodes is a root and who comes after them.
    Rows below a root are written once, rows whose chain ended without one are dropped, and only open
    rows are written again; snapshots without any root never enter.  Each round goes to the checkpoint
    folder, so plans stay small and a lost executor costs one round.
    """
    rounds = max_nodes.bit_length() - 1
    if 1 << rounds != max_nodes:
        raise ValueError("max_nodes must be a power of two")
    watched = roots.select(*SNAPSHOT).distinct()
    marks = roots.select(*SNAPSHOT, "pid").distinct().withColumn("hit", F.lit(True))
    nodes = process_nodes(procs) if young is None else process_nodes(procs).unionByName(young)
    nodes = nodes.join(watched, SNAPSHOT, "left_semi").join(marks, [*SNAPSHOT, "pid"], "left")
    ends = F.col("hit") | (F.col("pid") <= 1) | (F.col("ppid") == F.col("pid"))
    state = nodes.select(*SNAPSHOT, "pid", F.coalesce("hit", F.lit(False)).alias("hit"),
                         F.when(ends, None).otherwise(F.col("ppid")).alias("up"))
    # a chain that ended without a root reads like an ancestor that is not in the snapshot
    state = cut_lineage(state.filter("hit or up is not null"))
    hits, open_rows = state.filter("hit"), state.filter("not hit").drop("hit")
    for _ in range(rounds):
        target = hits.select(*SNAPSHOT, F.col("pid").alias("up"), F.lit(True).alias("up_hit"),
                             F.lit(None).cast("bigint").alias("up_up")).unionByName(
            open_rows.select(*SNAPSHOT, F.col("pid").alias("up"), F.lit(False).alias("up_hit"),
                             F.col("up").alias("up_up")))
        moved = cut_lineage(open_rows.join(target, [*SNAPSHOT, "up"]).filter(
            "up_hit or up_up is not null").select(*SNAPSHOT, "pid", "up_hit", "up_up"))
        hits = hits.unionByName(moved.filter("up_hit").select(
            *SNAPSHOT, "pid", F.lit(True).alias("hit"), F.lit(None).cast("bigint").alias("up")))
        open_rows = moved.filter("not up_hit").select(*SNAPSHOT, "pid", F.col("up_up").alias("up"))
        if open_rows.isEmpty():
            break
    return hits.select(*SNAPSHOT, "pid")


def agent_events(events: DataFrame, closure: DataFrame, salts: int = SALTS) -> DataFrame:
    """Events whose pid is in the closure of their snapshot (``snapshot_ts`` already attached).

    One pid may run a large share of all programs, so the semi join is salted; closure rows are
    three narrow columns.
    """
    return salted_join(events, closure.select(*SNAPSHOT, "pid"), [*SNAPSHOT, "pid"], "left_semi",
                       ["event_id"], salts)


def next_snapshots(procs: DataFrame) -> DataFrame:
    """Each host's snapshots with the time of the next one (null for the last).

    Within a day by window; the last snapshot of a day takes the first of the next day that has one.
    """
    snaps = (procs.select(*SNAPSHOT).distinct()
             .withColumn("_day", F.date_trunc("day", "snapshot_ts")))
    by_day = Window.partitionBy("host", "_day").orderBy("snapshot_ts")
    within = snaps.withColumn("_next", F.lead("snapshot_ts").over(by_day))
    days = (snaps.groupBy("host", "_day").agg(F.min("snapshot_ts").alias("_first"))
            .withColumn("_carry", F.lead("_first").over(
                Window.partitionBy("host").orderBy("_day"))).drop("_first"))
    return (within.join(days, ["host", "_day"])
            .select(*SNAPSHOT, F.coalesce("_next", "_carry").alias("next_ts")))


def root_changes(procs: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots added and removed between consecutive snapshots of a host.

    One aggregation over the current and the shifted sets; snapshots without roots count as well.
    """
    return _root_changes(next_snapshots(procs), roots)


def _root_changes(steps: DataFrame, roots: DataFrame) -> DataFrame:
    later = steps.select("host", F.col("next_ts").alias("snapshot_ts")).filter(
        F.col("snapshot_ts").isNotNull())
    now = roots.join(later, SNAPSHOT, "left_semi").select(
        *SNAPSHOT, "pid", F.lit(1).alias("now"), F.lit(0).alias("before"))
    before = (roots.join(steps.filter(F.col("next_ts").isNotNull()), SNAPSHOT)
              .select("host", F.col("next_ts").alias("snapshot_ts"), "pid",
                      F.lit(0).alias("now"), F.lit(1).alias("before")))
    return (now.unionByName(before).groupBy(*SNAPSHOT, "pid")
            .agg(F.max("now").alias("now"), F.max("before").alias("before"))
            .filter(F.col("now") != F.col("before"))
            .select(*SNAPSHOT, "pid",
                    F.when(F.col("now") == 1, "added").otherwise("removed").alias("change")))


def root_set_changes(procs: DataFrame, roots: DataFrame) -> DataFrame:
    """Snapshots whose root set differs from the one before, with its size; a host's first snapshot
    always counts.  Two sets differ exactly when something was added or removed.  The steps and the
    roots are small and written once, so the process table is read twice."""
    steps, roots = cut_lineage(next_snapshots(procs)), cut_lineage(roots.select(*SNAPSHOT, "pid").distinct())
    moved = _root_changes(steps, roots).select(*SNAPSHOT).distinct()
    not_first = steps.select("host", F.col("next_ts").alias("snapshot_ts"))
    first = steps.select(*SNAPSHOT).join(not_first, SNAPSHOT, "left_anti")
    sizes = roots.groupBy(*SNAPSHOT).agg(F.countDistinct("pid").alias("n_roots"))
    return (moved.unionByName(first).join(sizes, SNAPSHOT, "left")
            .select(*SNAPSHOT, F.coalesce("n_roots", F.lit(0).cast("bigint")).alias("n_roots")))


def asof_snapshot(events: DataFrame, snapshots: DataFrame,
                  tolerance: int = ROOT_REFRESH_SECONDS, salts: int = SALTS) -> DataFrame:
    """Add ``snapshot_ts``, the host's last snapshot at or before the event, and ``stale``, whether
    it is older than ``tolerance`` seconds.

    Snapshots are listed per host and hour, with the last one before the hour; every hour of a day that
    has snapshots is listed, and every day from a host's first to its last has one row that carries the
    last snapshot of earlier days.  An event looks up its hour, else its day, else the host's last day.
    The lists come from the snapshots alone, so the log is read once.  At one snapshot every five
    seconds an hour holds 720 times.
    """
    hours = _hours(snapshots)
    days = _days(snapshots)
    ends = days.groupBy("host").agg(F.max("_day").alias("_last_day"), F.max("_end").alias("_end_all"))
    df = events.withColumns({"_hour": F.date_trunc("hour", "ts"), "_day": F.date_trunc("day", "ts")})
    df = salted_join(df, hours, ["host", "_hour"], "left", ["event_id"], salts)
    df = salted_join(df, days.select("host", "_day", "_carry"), ["host", "_day"], "left", ["event_id"], salts)
    df = salted_join(df, ends, ["host"], "left", ["event_id"], salts)
    within = F.try_element_at(F.filter("_in", lambda t: t <= F.col("ts")), F.lit(-1))
    after = F.when(F.col("_day") > F.col("_last_day"), F.col("_end_all"))
    at = F.coalesce(within, F.col("_before"), F.col("_carry"), after)
    age = F.unix_micros("ts") - F.unix_micros("snapshot_ts")
    return (df.withColumn("snapshot_ts", at)
            .drop("_hour", "_day", "_in", "_before", "_carry", "_last_day", "_end_all")
            .withColumn("stale", age > tolerance * 1_000_000))


def _hours(snapshots: DataFrame) -> DataFrame:
    """All 24 hours of every day with snapshots: those of the hour and the day's last before it."""
    at = (snapshots.select(*SNAPSHOT).distinct()
          .groupBy("host", F.date_trunc("hour", "snapshot_ts").alias("_hour"))
          .agg(F.array_sort(F.collect_set("snapshot_ts")).alias("_in")))
    day = F.date_trunc("day", "_hour")
    every = at.select("host", day.alias("_day")).distinct().select(
        "host", F.explode(F.sequence("_day", F.expr("_day + interval 23 hours"),
                                     F.expr("interval 1 hour"))).alias("_hour"))
    listed = every.join(at, ["host", "_hour"], "left")
    by_day = (Window.partitionBy("host", F.date_trunc("day", "_hour")).orderBy("_hour")
              .rowsBetween(Window.unboundedPreceding, -1))
    return listed.withColumn("_before", F.last(F.try_element_at("_in", F.lit(-1)), ignorenulls=True)
                             .over(by_day))


def _days(snapshots: DataFrame) -> DataFrame:
    """Every day of a host from its first to its last snapshot: the last snapshot of earlier days."""
    at = snapshots.groupBy("host", F.date_trunc("day", "snapshot_ts").alias("_day")).agg(
        F.max("snapshot_ts").alias("_end"))
    span = at.groupBy("host").agg(F.min("_day").alias("a"), F.max("_day").alias("b")).select(
        "host", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("_day"))
    upto = Window.partitionBy("host").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    return span.join(at, ["host", "_day"], "left").withColumn(
        "_carry", F.last("_end", ignorenulls=True).over(upto))
