"""The whole audit: events to verdicts, and each guard on its own.

All guards work on one scan of the log.  Every guard's columns are computed only on its own rows (a CASE on
``guard``); only commands that name a SQL file and commits take part in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import or_
from types import MappingProxyType
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.argv import names_file
from veilwatch.operators.incarnations import (agent_intervals, events_of_agents, incarnations,
                                               recorded_facts)
from veilwatch.operators.joins import SALTS, computed_once
from veilwatch.operators.lineage import asof_snapshot
from veilwatch.plans import commits, containers, kv, path_policy, sql_audit
from veilwatch.plans.actions import match_action
from veilwatch.rules.registry import ACTIONS, Action
from veilwatch.sources.exec_events import watchlist_filter
from veilwatch.session import cut_lineage
from veilwatch.sources.policy import Policy

VERDICT_COLUMNS = ["event_id", "host", "ts", "action", "pid", "argv", "stale"]
NO_POLICY = Policy([], [])


class Context(NamedTuple):
    """What the guards look things up in."""

    contents: DataFrame
    diffs: DataFrame
    policy: Policy = NO_POLICY
    home: str | None = None
    salts: int = SALTS  # tasks a hot host, path or pid is spread over: about cores times its share
    tables: Mapping[str, DataFrame] = MappingProxyType({})  # of guards registered elsewhere


class Guard(NamedTuple):
    """A guard over matched commands.

    ``outcome(df, ctx, out, gate)`` adds its outcome on the rows where ``gate`` holds.  Before it,
    ``prepare(df)`` runs on all rows; rows where ``needs()`` holds get their facts by
    ``lookup(df, ctx)``, all others by ``inline(df, ctx)``.  Guards that share a step name the same
    function, which then runs once.  A guard with a lookup and no ``inline`` looks up all its rows.
    """

    outcome: Callable[[DataFrame, "Context", str, Column], DataFrame]
    prepare: Callable[[DataFrame], DataFrame] | None = None
    needs: Callable[[], Column] | None = None
    lookup: Callable[[DataFrame, "Context"], DataFrame] | None = None
    inline: Callable[[DataFrame, "Context"], DataFrame] | None = None


def _sql_files(df: DataFrame, ctx: Context) -> DataFrame:
    return sql_audit.with_file_facts(df, ctx.contents, ctx.policy, ctx.salts)


def _sql_inline(df: DataFrame, ctx: Context) -> DataFrame:
    return sql_audit.with_inline_facts(df, ctx.policy)


_SQL_STEPS = (sql_audit.with_sql_sources, names_file, _sql_files, _sql_inline)

# Registering a guard means one entry here and one registry row.
GUARDS = {
    "sql": Guard(lambda df, ctx, out, gate: sql_audit.with_sql_outcome(df, ctx.policy, out, gate),
                 *_SQL_STEPS),
    "kv": Guard(lambda df, ctx, out, gate: kv.with_kv_outcome(df, out, gate)),
    "cluster": Guard(lambda df, ctx, out, gate: sql_audit.with_cluster_outcome(df, out, gate),
                     *_SQL_STEPS),
    "container": Guard(lambda df, ctx, out, gate: containers.with_container_outcome(df, out, gate)),
    "path": Guard(lambda df, ctx, out, gate: path_policy.with_path_outcome(
        df, ctx.policy, ctx.home, out, gate)),
    "commit": Guard(lambda df, ctx, out, gate: commits.with_commit_outcome(df, out, gate),
                    needs=lambda: F.lit(True),
                    lookup=lambda df, ctx: commits.with_diff_facts(df, ctx.diffs)),
}


def _decide(df: DataFrame, ctx: Context, guards: dict[str, Guard]) -> DataFrame:
    """Every guard on its own rows, then one outcome column."""
    outs = []
    for name, guard in guards.items():
        out = f"_{name}_outcome"
        df = guard.outcome(df, ctx, out, F.col("guard") == name)
        outs.append(F.col(out))
    return (computed_once(df, "o", F.coalesce(*outs))
            .select(*VERDICT_COLUMNS, "o.verdict", "o.masked", "o.threat",
                    F.col("o.query").alias("masked_query")))


def _steps(guards: dict[str, Guard], field: str) -> list[Callable]:
    return list(dict.fromkeys(s for g in guards.values() if (s := getattr(g, field)) is not None))


def judge(matched: DataFrame, ctx: Context, guards: dict[str, Guard] | None = None,
          lookups: bool = True) -> DataFrame:
    """Verdicts for commands that already have an action.

    Rows that need a lookup go through its joins, all others through one shuffle-free pass.  Where both
    kinds are judged, the matched commands are written once, so the log is scanned once.  Without
    ``lookups`` only the rows that need none are judged, in a plan that can stream.
    """
    guards = GUARDS if guards is None else guards
    for step in _steps(guards, "prepare"):
        matched = step(matched)
    looks_up = {n: g for n, g in guards.items() if g.lookup}
    in_row = {n: g for n, g in guards.items() if not g.lookup or g.inline}
    if looks_up and in_row and lookups:
        matched = cut_lineage(matched)
    needs = reduce(or_, [(F.col("guard") == n) & g.needs() for n, g in looks_up.items()], F.lit(False))
    parts = []
    if looks_up and lookups:
        df = matched.filter(needs)
        for step in _steps(looks_up, "lookup"):
            df = step(df, ctx)
        parts.append(_decide(df, ctx, looks_up))
    if in_row:
        df = matched.filter(~needs) if looks_up else matched
        for step in _steps(in_row, "inline"):
            df = step(df, ctx)
        parts.append(_decide(df, ctx, in_row))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def audit(cmds: DataFrame, ctx: Context, *names: str, guards: dict[str, Guard] | None = None,
          rules: list[Action] = ACTIONS, lookups: bool = True) -> DataFrame:
    """Verdicts of some guards (all without names) over a command log."""
    guards = GUARDS if guards is None else guards
    guards = {n: guards[n] for n in names} if names else guards
    # a program has one registry row only, so leaving rows out cannot change the first match
    rules = [r for r in rules if r.guard in guards]
    if "stale" not in cmds.columns:
        cmds = cmds.withColumn("stale", F.lit(None).cast("boolean"))
    return judge(match_action(cmds, rules), ctx, guards, lookups)


def agent_executions(cmds: DataFrame, procs: DataFrame, salts: int = SALTS,
                     listed_stay: bool = True) -> DataFrame:
    """``event_id`` and ``stale`` of the executions by an agent process or one of its descendants.

    Agents are the roots of the last snapshot before an execution.  A process that started later is
    known by its own execution, which names its parent; every execution is such an edge, also of
    programs nobody watches.  All of a chain is taken as it was at the time of the execution, so a pid
    that was given to another process, or a parent that came later, does not count.  Only narrow columns
    of the log are read, and only the snapshots that an execution refers to.
    """
    narrow = cmds.select("event_id", "host", "ts", "pid", "ppid")
    placed = cut_lineage(asof_snapshot(narrow, procs, salts=salts))
    return of_agents(placed, procs, salts, listed_stay)


def of_agents(placed: DataFrame, procs: DataFrame, salts: int = SALTS, listed_stay: bool = True) -> DataFrame:
    """``agent_executions`` of executions that already have their ``snapshot_ts``."""
    lives = incarnations(recorded_facts(placed, procs, listed_stay))
    return events_of_agents(placed, agent_intervals(lives), salts).select("event_id", "stale")


def agent_commands(cmds: DataFrame, procs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Watched commands run by an agent process or one of its descendants, with ``stale``: whether the
    agents were last looked up longer ago than the refresh time.

    The test on the program name reaches the scan where the name is stored.
    """
    return watchlist_filter(cmds).join(agent_executions(cmds, procs, salts), "event_id")


def audit_commands(cmds: DataFrame, procs: DataFrame, ctx: Context) -> DataFrame:
    """Events to verdicts: watch list, lineage, action, guard."""
    return audit(agent_commands(cmds, procs, ctx.salts), ctx)
