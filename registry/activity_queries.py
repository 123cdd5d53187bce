"""Diffs, lineage, the whole audit, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import (DUCK_TS, flat_verdicts, folder, joined, number, query, stamp)
from registry.command_queries import VERDICT
from registry.fixtures import (COMMAND_SQL, CTES, command_log, commands, commit_diffs, context,
                               processes, quote, raw_log, table, values)
from registry.masking_queries import hits_sql
from veilwatch.functions.argv import with_argv
from veilwatch.functions.text import basename
from veilwatch.operators.diff_pieces import cut_diffs, pieced_diff_lines
from veilwatch.operators.diffs import commit_hits, diff_lines, hunk_start, line_hits
from veilwatch.operators.incarnations import incarnations, recorded_facts
from veilwatch.operators.lineage import (asof_snapshot, descendants, flag_roots, next_snapshots,
                                         root_changes, root_pids, root_set_changes)
from veilwatch.plans.commits import hit_text
from veilwatch.plans.dispatch import agent_executions, audit, audit_commands
from veilwatch.plans.reports import (build_reports, detail_lines, report_kind, report_text,
                                     threat_message)
from veilwatch.rules import threat_texts as T
from veilwatch.rules.sql_rules import SQL_TOOLS
from veilwatch.sources.report_days import ReportDays
from veilwatch.sources.reports import write_reports
from veilwatch.sources.snapshots import (numeric_entries, read_process_snapshots,
                                         write_process_snapshots)
from veilwatch.sources.exec_events import read_command_log
from veilwatch.session import cut_lineage
from veilwatch.streaming.agent_stream import finish_agent_audit, stream_agent_audit
from veilwatch.streaming.audit_stream import (read_root_changes, stream_audit, stream_reports_of,
                                              stream_root_changes, stream_verdicts, without_replays)

# --- SQL: diffs -----------------------------------------------------------------------------------

_ROOT = "starts_with(lower(trim(comm)), 'claude') OR contains(lower(cmdline), 'claude')"


def _lineage(n: str, procs: str) -> dict[str, str]:
    """Roots, closure of the snapshots, and the agents' executions, of which young processes are part."""
    def walk(nodes: str, name: str) -> str:
        return f"""SELECT host, snapshot_ts, pid, pid AS cur, 0 AS n FROM {nodes}
        UNION ALL SELECT w.host, w.snapshot_ts, w.pid, p.ppid, w.n + 1 FROM {name} w
        JOIN {nodes} p ON p.host = w.host AND p.snapshot_ts = w.snapshot_ts AND p.pid = w.cur
        WHERE w.n < 31 AND w.cur > 1 AND p.ppid <> p.pid"""

    def closure(name: str) -> str:
        return f"""SELECT DISTINCT w.host, w.snapshot_ts, w.pid FROM {name} w JOIN {n}_roots r
        ON r.host = w.host AND r.snapshot_ts = w.snapshot_ts AND r.pid = w.cur"""

    return {
        f"{n}_roots": f"SELECT DISTINCT host, snapshot_ts, pid FROM {procs} WHERE {_ROOT}",
        f"{n}_nodes": f"SELECT host, snapshot_ts, pid, min(ppid) AS ppid FROM {procs} GROUP BY ALL",
        f"{n}_walk": walk(f"{n}_nodes", f"{n}_walk"),
        f"{n}_closure": closure(f"{n}_walk"),
        f"{n}_snaps": f"SELECT DISTINCT host, snapshot_ts FROM {procs}",
        f"{n}_asof": f"""SELECT e.event_id, e.ts, s.snapshot_ts, e.host, e.pid, e.ppid, e.base FROM x_log e
        ASOF LEFT JOIN {n}_snaps s ON e.host = s.host AND e.ts >= s.snapshot_ts""",
        f"{n}_grown": f"""SELECT * FROM {n}_nodes UNION ALL SELECT e.host, e.snapshot_ts, e.pid, min(e.ppid) FROM {n}_asof e
        LEFT JOIN {n}_nodes p ON p.host = e.host AND p.snapshot_ts = e.snapshot_ts AND p.pid = e.pid
        WHERE e.snapshot_ts IS NOT NULL AND p.pid IS NULL GROUP BY e.host, e.snapshot_ts, e.pid""",
        f"{n}_agentwalk": walk(f"{n}_grown", f"{n}_agentwalk"),
        f"{n}_family": closure(f"{n}_agentwalk"),
        f"{n}_agent": f"""SELECT e.event_id, CAST(e.ts - e.snapshot_ts > INTERVAL 5 SECOND AS BIGINT) AS stale
        FROM {n}_asof e JOIN {n}_family c ON c.host = e.host AND c.snapshot_ts = e.snapshot_ts AND c.pid = e.pid""",
    }


def _lives(n: str, only: str) -> dict[str, str]:
    """A pid's processes one after the other, and the walk of every event at its own time."""
    return {
        f"{n}_facts": f"""SELECT host, snapshot_ts, pid, snapshot_ts AS since, 0 AS ran, ppid, is_root FROM x_rlisted
        UNION ALL SELECT host, snapshot_ts, pid, since, 1, ppid, FALSE FROM x_rran r WHERE TRUE {only}""",
        f"{n}_steps": f"""SELECT *, lag(ppid) OVER w IS DISTINCT FROM ppid AS moved FROM {n}_facts
        WINDOW w AS (PARTITION BY host, snapshot_ts, pid ORDER BY since, ran)""",
        f"{n}_lives": f"""SELECT * FROM (SELECT host, snapshot_ts, pid, since, ppid, is_root,
        coalesce(lead(since) OVER (PARTITION BY host, snapshot_ts, pid ORDER BY since, ran), TIMESTAMP '9999-12-31 23:59:59') AS til
        FROM {n}_steps WHERE moved) WHERE since < til""",
        f"{n}_walk": f"""SELECT e.event_id, e.host, e.snapshot_ts, e.ts, e.pid AS cur, 0 AS n, l.is_root, l.ppid
        FROM x_rplaced e JOIN {n}_lives l ON l.host = e.host AND l.snapshot_ts = e.snapshot_ts AND l.pid = e.pid
          AND e.ts >= l.since AND e.ts < l.til
        UNION ALL SELECT w.event_id, w.host, w.snapshot_ts, w.ts, l.pid, w.n + 1, l.is_root, l.ppid FROM {n}_walk w
        JOIN {n}_lives l ON l.host = w.host AND l.snapshot_ts = w.snapshot_ts AND l.pid = w.ppid
          AND w.ts >= l.since AND w.ts < l.til
        WHERE w.n < 31 AND w.cur > 1 AND w.ppid <> w.cur AND NOT w.is_root""",
    }


CTES.update({
    "x_dl": """SELECT event_id, rtrim(unnest(ls), chr(13)) AS line, generate_subscripts(ls, 1) AS i FROM (
        SELECT event_id, string_split(CASE WHEN ends_with(diff, chr(10)) THEN left(diff, length(diff) - 1) ELSE diff END,
          chr(10)) AS ls FROM x_diffs WHERE diff <> '')""",
    "x_dk": """SELECT *, CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END AS header,
          CASE WHEN starts_with(line, '@@') AND TRY_CAST(regexp_extract(line, '^[^+]*\\+([0-9]+)', 1) AS HUGEINT) < 4294967296
               THEN greatest(TRY_CAST(regexp_extract(line, '^[^+]*\\+([0-9]+)', 1) AS BIGINT) - 1, 0) END AS start,
          starts_with(line, '@@') AS hunk FROM x_dl""",
    "x_ds": """SELECT *, CASE WHEN header IS NULL AND NOT hunk AND NOT starts_with(line, '-') THEN 1 ELSE 0 END AS counted,
          sum(CASE WHEN header IS NOT NULL OR start IS NOT NULL THEN 1 ELSE 0 END)
            OVER (PARTITION BY event_id ORDER BY i) AS seg,
          last_value(header IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY i) AS file FROM x_dk""",
    "x_dn": """SELECT event_id, i, coalesce(file, '') AS file, counted, line,
          coalesce(max(start) OVER (PARTITION BY event_id, seg), 0)
            + sum(counted) OVER (PARTITION BY event_id, seg ORDER BY i) AS number,
          starts_with(line, '+') AND NOT starts_with(line, '+++') AS added FROM x_ds""",
    "x_added": "SELECT event_id, i, file, number, substr(line, 2) AS t FROM x_dn WHERE counted = 1 AND added",
    "x_hits": "SELECT * FROM (" + hits_sql("event_id, i, file, number", "t", "x_added") + ")",
    "x_commithits": """SELECT event_id, count(*) AS n, string_agg(file || ':' || CAST(number AS BIGINT) || ' · ' || kind || ' → '
          || snippet, ' | ' ORDER BY i, ord, pos) AS hits FROM x_hits GROUP BY event_id""",
    "x_commit": """SELECT m.event_id, m.action, CASE WHEN c.code IS NULL THEN 'Allow' ELSE 'Block' END AS verdict, FALSE AS masked,
          c.code, CASE WHEN c.code IS NOT NULL THEN 'git' END AS tool, CAST(NULL AS VARCHAR) AS subject, c.details,
          CAST(NULL AS VARCHAR) AS inner_code
        FROM x_matched m JOIN (SELECT m.event_id,
            CASE WHEN m.cwd IS NULL THEN NULL WHEN d.event_id IS NULL THEN 'GIT_COMMIT_INSPECT_FAILED'
              WHEN d.files_text = '' THEN NULL WHEN d.error IS NOT NULL THEN 'GIT_COMMIT_INSPECT_FAILED'
              WHEN h.n > 0 THEN 'SECRET_LEAK' END AS code,
            CASE WHEN m.cwd IS NULL THEN NULL WHEN d.event_id IS NULL THEN 'no staged diff was recorded for this commit'
              WHEN d.files_text = '' THEN NULL WHEN d.error IS NOT NULL THEN d.error ELSE h.hits END AS details
          FROM x_matched m LEFT JOIN x_diffs d ON d.event_id = m.event_id LEFT JOIN x_commithits h ON h.event_id = m.event_id
          WHERE m.guard = 'commit') c USING (event_id)""",

    # --- lineage
    **_lineage("x", "x_procs"),
    # few pids, so that each is many processes; a parent is looked up at the time of the event
    "x_rlog": """SELECT event_id, host, ts, 2 + event_id % 41 AS pid, 2 + (event_id * 7 + event_id // 100) % 41 AS ppid FROM x_log""",
    "x_rprocs": """SELECT host, snapshot_ts, 2 + pid % 23 AS pid, 1 + ppid % 40 AS ppid, comm, cmdline FROM x_procs
        WHERE pid % 3 = 0""",
    "x_rlisted": f"""SELECT host, snapshot_ts, pid, min(ppid) AS ppid, bool_or({_ROOT}) AS is_root FROM x_rprocs GROUP BY ALL""",
    "x_rplaced": """SELECT e.*, s.snapshot_ts FROM x_rlog e ASOF JOIN (SELECT DISTINCT host, snapshot_ts FROM x_rprocs) s
        ON e.host = s.host AND e.ts >= s.snapshot_ts""",
    "x_rran": """SELECT host, snapshot_ts, pid, ts AS since, min(ppid) AS ppid FROM x_rplaced GROUP BY ALL""",
    **_lives("x_rstay", "AND NOT EXISTS (FROM x_rlisted l WHERE l.host = r.host AND l.snapshot_ts = r.snapshot_ts AND l.pid = r.pid)"),
    **_lives("x_rmove", ""),
    # the same without the processes that started after their snapshot
    "x_yprocs": "SELECT * FROM x_procs WHERE pid % 7 NOT IN (3, 4)",
    **_lineage("x_y", "x_yprocs"),
    "x_seq": """SELECT host, snapshot_ts, lag(snapshot_ts) OVER (PARTITION BY host ORDER BY snapshot_ts) AS before
        FROM x_snaps""",
    "x_moves": """SELECT s.host, s.snapshot_ts, r.pid, 'added' AS change FROM x_seq s
          JOIN x_roots r ON r.host = s.host AND r.snapshot_ts = s.snapshot_ts
          LEFT JOIN x_roots o ON o.host = s.host AND o.snapshot_ts = s.before AND o.pid = r.pid
          WHERE s.before IS NOT NULL AND o.pid IS NULL
        UNION ALL SELECT s.host, s.snapshot_ts, o.pid, 'removed' FROM x_seq s
          JOIN x_roots o ON o.host = s.host AND o.snapshot_ts = s.before
          LEFT JOIN x_roots r ON r.host = s.host AND r.snapshot_ts = s.snapshot_ts AND r.pid = o.pid
          WHERE r.pid IS NULL""",
    "x_rootlists": """SELECT s.host, s.snapshot_ts, list(r.pid ORDER BY r.pid) FILTER (r.pid IS NOT NULL) AS pids
        FROM x_snaps s LEFT JOIN x_roots r ON r.host = s.host AND r.snapshot_ts = s.snapshot_ts GROUP BY ALL""",

    # --- all verdicts, messages
    "x_all": """SELECT * FROM x_sql UNION ALL SELECT * FROM x_kv UNION ALL SELECT * FROM x_container
        UNION ALL SELECT * FROM x_cluster UNION ALL SELECT * FROM x_path UNION ALL SELECT * FROM x_commit""",
    "x_msgs": values("code, head, item, tail", [(c, *m) for c, m in T.MESSAGES.items()]),
    "x_parts": """SELECT *, CASE WHEN details IS NULL OR details = '' THEN CAST([] AS VARCHAR[])
          ELSE string_split(details, ' | ') END AS dl FROM x_all WHERE verdict <> 'Allow'""",
})


def _message_sql(code: str) -> str:
    def fill(t):
        return (f"replace(replace(replace(replace(replace(replace({t}, '<code>', m.code), '<tool>', coalesce(p.tool, '')), "
                "'<subject>', coalesce(p.subject, '')), '<n>', CAST(len(p.dl) AS VARCHAR)), "
                "'<first>', coalesce(p.dl[1], '')), '<list>', array_to_string(p.dl, ', '))")
    head = (f"CASE WHEN m.code = 'DOCKER_EXEC' AND list_contains(p.dl, 'privileged') "
            f"THEN replace({quote(T.EXEC_PRIVILEGED_HEAD)}, '<code>', m.code) ELSE {fill('m.head')} END")
    none = "CAST([] AS VARCHAR[])"
    return f"""SELECT p.event_id, array_to_string(list_concat(list_concat([{head}],
          CASE WHEN m.item IS NOT NULL THEN list_transform(p.dl, lambda d: m.item || d) ELSE {none} END),
          list_concat(CASE WHEN m.code = 'DATA_POLICY_BLOCK' AND len(p.dl) > 0
              THEN [{fill(quote(T.PROTECTED_COLUMNS_LINE))}] ELSE {none} END,
            CASE WHEN m.tail IS NOT NULL THEN [{fill('m.tail')}] ELSE {none} END)), chr(10)) AS message
        FROM x_parts p JOIN x_msgs m ON m.code = p.{code}"""


CTES.update({
    "x_own": _message_sql("code"),
    "x_inner": _message_sql("inner_code"),
    "x_message": """SELECT o.event_id, o.message || coalesce(chr(10) || '  ' || i.message, '') AS message
        FROM x_own o LEFT JOIN x_inner i USING (event_id)""",
    "x_reports": f"""SELECT a.event_id, l.host, l.ts, CASE a.verdict WHEN 'Block' THEN 'BLOCKED' ELSE 'WARNING' END AS kind, a.code,
          a.action AS tool, l.pid, array_to_string(l.argv, ' ') AS command, m.message AS detail
        FROM x_all a JOIN x_log l USING (event_id) JOIN x_message m USING (event_id)""",
})

_REPORT = f"""event_id, host, strftime(ts, '{DUCK_TS}') AS ts, kind, code, tool, pid, command, md5(detail) AS detail,
  strftime(ts, '%Y-%m-%d') AS report_date"""


# --- W1, W2, C15, A7, G4: diffs -------------------------------------------------------------------

@query("w1_diff_file", """SELECT event_id, file, count(*) AS n_lines, count(*) FILTER (added) AS n_added
       FROM x_dn WHERE counted = 1 GROUP BY ALL""")
def diff_files(spark, sf):
    return diff_lines(commit_diffs(spark, sf)).groupBy("event_id", "file").agg(
        F.count("*").alias("n_lines"), F.count_if("added").alias("n_added"))


@query("w2_diff_line", """SELECT event_id, file, CAST(number AS BIGINT) AS line, CAST(added AS BIGINT) AS added,
       md5(CASE WHEN added THEN substr(line, 2) ELSE line END) AS digest FROM x_dn WHERE counted = 1""")
def numbered_lines(spark, sf):
    return diff_lines(commit_diffs(spark, sf)).select(
        "event_id", "file", "line", number(F.col("added")).alias("added"), F.md5("text").alias("digest"))


@query("w2_pieced_lines", """SELECT event_id, file, CAST(number AS BIGINT) AS line, CAST(added AS BIGINT) AS added,
       md5(CASE WHEN added THEN substr(line, 2) ELSE line END) AS digest FROM x_dn WHERE counted = 1""")
def lines_of_pieces(spark, sf):
    """Diffs stored in pieces that cut lines anywhere, numbered over the borders."""
    return pieced_diff_lines(cut_diffs(commit_diffs(spark, sf, spread=False), 61), 4).select(
        "event_id", "file", "line", number(F.col("added")).alias("added"), F.md5("text").alias("digest"))


@query("c15_pieced_hits", "SELECT event_id, file, CAST(number AS BIGINT) AS line, kind, snippet FROM x_hits")
def hits_of_pieces(spark, sf):
    return line_hits(pieced_diff_lines(cut_diffs(commit_diffs(spark, sf, spread=False), 1000), 4))


@query("w2_hunk_start", """SELECT event_id, i AS pos, CAST(CASE WHEN n < 4294967296 THEN n END AS BIGINT) AS start FROM (
       SELECT event_id, i, TRY_CAST(regexp_extract(line, '^[^+]*\\+([0-9]+)', 1) AS HUGEINT) AS n
       FROM x_dl WHERE starts_with(line, '@@'))""")
def hunk_starts(spark, sf):
    body = F.regexp_replace("diff", r"\n\z", "")
    lines = commit_diffs(spark, sf).select("event_id", F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    return lines.filter(F.col("line").startswith("@@")).select(
        "event_id", (number(F.col("pos")) + 1).alias("pos"), hunk_start(F.col("line")).alias("start"))


@query("c15_diff_hits", "SELECT event_id, file, CAST(number AS BIGINT) AS line, kind, snippet FROM x_hits")
def hits(spark, sf):
    return line_hits(diff_lines(commit_diffs(spark, sf)))


@query("a7_commit_hits", """SELECT d.event_id, coalesce(h.n, 0) AS n_hits, coalesce(h.hits, '') AS hits
       FROM x_diffs d LEFT JOIN x_commithits h USING (event_id)""")
def hits_of_commits(spark, sf):
    done = commit_hits(commit_diffs(spark, sf))
    return done.select("event_id", "n_hits", joined(F.transform("hits", lambda h: hit_text(h))).alias("hits"))


@query("g4_commits", f"SELECT {VERDICT} FROM x_commit")
def commit_verdicts(spark, sf):
    return flat_verdicts(audit(command_log(spark, sf), context(spark, sf), "commit"))


# --- S3, F3, J2, J5, J6, W3, T1: lineage ----------------------------------------------------------

def _roots(procs, **how):
    return flag_roots(procs, **how).filter("is_root").select("host", "snapshot_ts", "pid")


def _named(df, *more):
    return df.select("host", stamp("snapshot_ts").alias("snapshot_ts"), "pid", *more)


_ROW = f"host, strftime(snapshot_ts, '{DUCK_TS}') AS snapshot_ts, pid"


@query("s3_process_snapshots", """SELECT CAST(e AS BIGINT) AS pid, count(*) AS n FROM (
       SELECT CASE event_id % 5 WHEN 0 THEN 'self' WHEN 1 THEN event_id || 'x' ELSE CAST(user_id AS VARCHAR) END AS e FROM events)
       WHERE regexp_matches(e, '^[0-9]+$') GROUP BY ALL""")
def entries(spark, sf):
    made = table(spark, sf, "events").select(F.expr(
        "CASE event_id % 5 WHEN 0 THEN 'self' WHEN 1 THEN event_id || 'x' ELSE CAST(user_id AS STRING) END").alias("entry"))
    return numeric_entries(made).groupBy("pid").agg(F.count("*").alias("n"))


@query("f3_roots", f"SELECT {_ROW} FROM x_roots")
def roots(spark, sf):
    path = folder(spark, "snapshots")
    write_process_snapshots(processes(spark, sf), path)
    return _named(_roots(read_process_snapshots(spark, path)))


@query("f3b_roots_strict", f"""SELECT {_ROW} FROM x_procs WHERE trim(comm) = 'claude'
       OR (contains(cmdline, 'claude') AND contains(cmdline, 'anthropic'))""")
def strict_roots(spark, sf):
    return _named(_roots(processes(spark, sf), strict=True))


@query("t1_root_pids", f"""SELECT host, strftime(snapshot_ts, '{DUCK_TS}') AS snapshot_ts, pid,
       row_number() OVER (PARTITION BY host, snapshot_ts ORDER BY pid) AS nth FROM x_roots""")
def sorted_roots(spark, sf):
    listed = root_pids(processes(spark, sf)).select("host", "snapshot_ts", F.posexplode("pids").alias("nth", "pid"))
    return _named(listed.withColumn("nth", number(F.col("nth")) + 1), "nth")


@query("j2_descendants", f"SELECT {_ROW} FROM x_closure")
def closure(spark, sf):
    procs = processes(spark, sf)
    return _named(descendants(procs, _roots(procs)))


@query("j2b_agent_events", "SELECT event_id FROM x_agent")
def events_of_agents(spark, sf):
    return agent_executions(command_log(spark, sf), processes(spark, sf)).select("event_id")


@query("j2_repeated_snapshots", f"SELECT {_ROW} FROM x_closure")
def repeated_snapshots(spark, sf):
    """Every process delivered twice, once with a larger parent as well, changes nothing."""
    procs = processes(spark, sf)
    other = procs.withColumn("ppid", F.col("ppid") + 1000)
    twice = procs.unionByName(procs).unionByName(other)
    return _named(descendants(twice, _roots(twice)))


def _reused(spark, sf):
    """A log and snapshots in which a few pids are given to many processes."""
    log = command_log(spark, sf).select(
        "event_id", "host", "ts", F.expr("2 + event_id % 41").alias("pid"),
        F.expr("2 + (event_id * 7 + event_id div 100) % 41").alias("ppid"))
    procs = processes(spark, sf).filter("pid % 3 = 0").withColumns(
        {"pid": F.expr("2 + pid % 23"), "ppid": F.expr("1 + ppid % 40")})
    return log, procs


@query("j2b_reused_pids", "SELECT DISTINCT event_id FROM x_rstay_walk WHERE is_root")
def reused_pids(spark, sf):
    """Pids that are many processes: every node of a chain is looked up at the time of the event."""
    return agent_executions(*_reused(spark, sf)).select("event_id")


@query("j2b_reused_listed_pids", "SELECT DISTINCT event_id FROM x_rmove_walk WHERE is_root")
def reused_listed_pids(spark, sf):
    """The same where an execution below another parent also ends a process that the snapshot lists."""
    return agent_executions(*_reused(spark, sf), listed_stay=False).select("event_id")


@query("j2b_incarnations", f"""SELECT {_ROW}, strftime(since, '{DUCK_TS}') AS since, strftime(til, '{DUCK_TS}') AS until, ppid,
       CAST(is_root AS BIGINT) AS is_root FROM x_rmove_lives
       WHERE (host, snapshot_ts) IN (SELECT (host, snapshot_ts) FROM x_rplaced)""")
def process_lives(spark, sf):
    log, procs = _reused(spark, sf)
    lives = incarnations(recorded_facts(asof_snapshot(log, procs), procs, listed_stay=False))
    return _named(lives, stamp("since").alias("since"), stamp("until").alias("until"), "ppid",
                  number(F.col("is_root")).alias("is_root"))


def _without_young(procs):
    return procs.filter("pid % 7 not in (3, 4)")


@query("j2b_young_children", "SELECT event_id, stale FROM x_y_agent")
def young_children(spark, sf):
    """Processes that started after their snapshot, and their own children, belong to the agent."""
    found = agent_executions(command_log(spark, sf), _without_young(processes(spark, sf)))
    return found.select("event_id", number(F.col("stale")).alias("stale"))


@query("j6_stale", """SELECT a.event_id, a.verdict, g.stale FROM x_all a JOIN x_y_agent g USING (event_id)""")
def stale_verdicts(spark, sf):
    done = audit_commands(command_log(spark, sf), _without_young(processes(spark, sf)), context(spark, sf))
    return done.select("event_id", "verdict", number(F.col("stale")).alias("stale"))


@query("j5_root_changes", f"SELECT {_ROW}, change FROM x_moves")
def changes(spark, sf):
    procs = processes(spark, sf)
    return _named(root_changes(procs, _roots(procs)), "change")


@query("u1_set_difference", "SELECT host, change, count(*) AS n FROM x_moves GROUP BY ALL")
def set_difference(spark, sf):
    procs = processes(spark, sf)
    return root_changes(procs, _roots(procs)).groupBy("host", "change").agg(F.count("*").alias("n"))


@query("j6_asof", f"""SELECT event_id, strftime(snapshot_ts, '{DUCK_TS}') AS snapshot_ts,
       CAST(ts - snapshot_ts > INTERVAL 5 SECOND AS BIGINT) AS stale FROM x_asof""")
def as_of(spark, sf):
    log = command_log(spark, sf).select("event_id", "host", "ts")
    return asof_snapshot(log, processes(spark, sf)).select(
        "event_id", stamp("snapshot_ts").alias("snapshot_ts"), number(F.col("stale")).alias("stale"))


@query("w3_snapshot_order", f"""SELECT host, strftime(snapshot_ts, '{DUCK_TS}') AS snapshot_ts,
       strftime(lead(snapshot_ts) OVER (PARTITION BY host ORDER BY snapshot_ts), '{DUCK_TS}') AS next_ts FROM x_snaps""")
def snapshot_order(spark, sf):
    return next_snapshots(processes(spark, sf)).select(
        "host", stamp("snapshot_ts").alias("snapshot_ts"), stamp("next_ts").alias("next_ts"))


@query("w3_root_set_changes", f"""SELECT host, strftime(snapshot_ts, '{DUCK_TS}') AS snapshot_ts, n_roots FROM (
       SELECT *, coalesce(len(pids), 0) AS n_roots, row_number() OVER w AS nth, lag(pids) OVER w AS before FROM x_rootlists
       WINDOW w AS (PARTITION BY host ORDER BY snapshot_ts)) WHERE nth = 1 OR pids IS DISTINCT FROM before""")
def changed_sets(spark, sf):
    procs = processes(spark, sf)
    return root_set_changes(procs, _roots(procs)).select(
        "host", stamp("snapshot_ts").alias("snapshot_ts"), "n_roots")


# --- G9, U3, C18, R1 to R4, T3, A8, G10, S7: the whole audit and its reports ----------------------

@query("g9_audit_commands", f"SELECT {VERDICT} FROM x_all WHERE event_id IN (SELECT event_id FROM x_agent)")
def whole_audit(spark, sf):
    return flat_verdicts(audit_commands(command_log(spark, sf), processes(spark, sf), context(spark, sf)))


@query("u3_all_verdicts", f"SELECT {VERDICT} FROM x_all")
def all_verdicts(spark, sf):
    return flat_verdicts(_verdicts(spark, sf))


def _verdicts(spark, sf):
    return audit(command_log(spark, sf), context(spark, sf))


@query("c18_threat_codes", "SELECT code, inner_code, count(*) AS n FROM x_all WHERE code IS NOT NULL GROUP BY ALL")
def codes(spark, sf):
    t = _verdicts(spark, sf).groupBy("threat.code", "threat.inner_code").agg(F.count("*").alias("n"))
    return t.filter(F.col("code").isNotNull())


@query("r1_messages", "SELECT event_id, message FROM x_message")
def messages(spark, sf):
    text = threat_message(F.col("threat"))
    return _verdicts(spark, sf).select("event_id", F.explode(F.array_compact(F.array(text))).alias("message"))


@query("a8_finding_counts", "SELECT event_id, code, CAST(len(dl) AS BIGINT) AS n FROM x_parts")
def finding_counts(spark, sf):
    v = _verdicts(spark, sf).select("event_id", "threat.code", number(F.size("threat.details")).alias("n"))
    return v.filter(F.col("code").isNotNull())


@query("r2_report_text", """SELECT event_id, md5(repeat('═', 64) || chr(10) || '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ']  '
       || kind || '  [' || code || ']' || chr(10) || 'Tool:    ' || tool || chr(10) || 'PID:     ' || pid || chr(10)
       || 'Command: ' || command || chr(10) || chr(10) || detail || chr(10) || repeat('─', 64) || chr(10) || chr(10)) AS digest
       FROM x_reports""")
def texts(spark, sf):
    reports = build_reports(_verdicts(spark, sf))
    return reports.select("event_id", F.md5(report_text()).alias("digest"))


@query("r3_report_kind", "SELECT kind, code, count(*) AS n FROM x_reports GROUP BY ALL")
def kinds(spark, sf):
    v = _verdicts(spark, sf).select(report_kind(F.col("verdict")).alias("kind"), "threat.code")
    return v.groupBy("kind", "code").agg(F.count("*").alias("n")).filter(F.col("kind").isNotNull())


@query("r4_report_date", "SELECT strftime(ts, '%Y-%m-%d') AS report_date, kind, count(*) AS n FROM x_reports GROUP BY ALL")
def dates(spark, sf):
    reports = build_reports(_verdicts(spark, sf))
    return reports.groupBy(F.col("report_date").cast("string").alias("report_date"), "kind").agg(
        F.count("*").alias("n"))


@query("t3_detail_lines", """SELECT event_id, array_to_string(list_transform(list_filter(list_transform(
         string_split(detail, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:3],
         lambda x: left(x, list_max(list_filter(range(0, 53), lambda k: strlen(left(x, k)) <= 52)))), ' | ') AS lines
       FROM x_reports""")
def first_lines(spark, sf):
    reports = build_reports(_verdicts(spark, sf))
    return reports.select("event_id", joined(detail_lines(F.col("detail"))).alias("lines"))


def _flat_reports(df):
    return df.select("event_id", "host", stamp("ts").alias("ts"), "kind", "code", "tool", "pid", "command",
                     F.md5("detail").alias("detail"), F.col("report_date").cast("string").alias("report_date"))


@query("g10_reports", f"SELECT {_REPORT} FROM x_reports WHERE event_id IN (SELECT event_id FROM x_agent)")
def reports_of_agents(spark, sf):
    verdicts = audit_commands(command_log(spark, sf), processes(spark, sf), context(spark, sf))
    return _flat_reports(build_reports(verdicts))


@query("s7_report_sink", f"SELECT {_REPORT} FROM x_reports")
def sink(spark, sf):
    path = folder(spark, "reports")
    write_reports(build_reports(_verdicts(spark, sf)), path)
    return _flat_reports(spark.read.parquet(path))


@query("s7_closed_days", f"SELECT {_REPORT} FROM x_reports")
def closed_days(spark, sf):
    """Every day in batches of two streams, all days but the last merged to one table."""
    path = folder(spark, "reports")
    reports = cut_lineage(build_reports(_verdicts(spark, sf)))
    for i, name in enumerate(["s-0", "s-1", "s-2", "t-0"]):
        write_reports(reports.filter(F.pmod("event_id", F.lit(4)) == i), path, name)
    days = ReportDays(spark, path)
    days.compact(str(reports.agg(F.max("report_date")).first()[0]))
    return _flat_reports(days.read())


# --- X1 to X4: streams ----------------------------------------------------------------------------

def _stream(spark, sf, name: str):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _log_stream(spark, sf):
    log = spark.sql(COMMAND_SQL, events=_stream(spark, sf, "events"), commands=commands(spark))
    raw = log.withColumn("cmdline", F.replace("argv_text", F.lit("\u001f"), F.lit("\u0000")).cast("binary"))
    return with_argv(raw.drop("argv_text"))


_FILE_FLAGS = sorted({f for tool in SQL_TOOLS.values() for f in tool.file_flags})
CTES["x_inrow"] = f"""SELECT event_id FROM x_matched WHERE guard IN ('kv', 'container', 'path') OR (guard IN ('sql', 'cluster')
  AND len(list_filter(argv, lambda x: list_contains({quote(_FILE_FLAGS)}, x)
    OR {" OR ".join(f"starts_with(x, {quote(f + '=')})" for f in _FILE_FLAGS)})) = 0)"""


@query("x1_stream_verdicts", f"SELECT {VERDICT} FROM x_all WHERE event_id IN (SELECT event_id FROM x_inrow)")
def streamed_verdicts(spark, sf):
    path = folder(spark, "verdicts")
    stream = (stream_verdicts(_log_stream(spark, sf), context(spark, sf)).writeStream.format("parquet")
              .option("path", path).option("checkpointLocation", folder(spark, "state"))
              .outputMode("append").trigger(availableNow=True).start())
    stream.awaitTermination()
    return flat_verdicts(spark.read.parquet(path))


_BACKLOG = {"availableNow": True}
_WHOLE = "60 days"  # the files below come up to a month late


def _files(spark) -> int:
    """Files of a part written by ``_in_pieces``, at most: the partitions of ``spread_table``."""
    return spark.sparkContext.defaultParallelism


def _in_pieces(df, time: str, write) -> None:
    """Write rows as they may arrive: those after the first ten days, the first ten days (late), and these a
    second time.  A part is as many files as the rows have partitions."""
    early = F.dayofmonth(time) <= 10
    for part in (~early, early, early):
        write(df.filter(part))


@query("x2_stream_agent_reports", f"SELECT {_REPORT} FROM x_reports WHERE event_id IN (SELECT event_id FROM x_agent)")
def streamed_reports(spark, sf):
    path, log = folder(spark, "reports"), folder(spark, "log")
    write = lambda df: df.withColumns({"basename": basename(F.col("filename"))}).write.mode("append").parquet(log)
    _in_pieces(raw_log(spark, sf), "ts", write)
    stream = with_argv(read_command_log(spark, log, streaming=True, per_batch=_files(spark)))
    stored = lambda: read_command_log(spark, log)
    stream_audit(stream, lambda: context(spark, sf), path, folder(spark, "state"), lambda: processes(spark, sf),
                 stored, _BACKLOG, _WHOLE).awaitTermination()
    return _flat_reports(spark.read.parquet(path))


@query("x2_kept_lineage", f"SELECT {_REPORT} FROM x_reports WHERE event_id IN (SELECT event_id FROM x_agent)")
def reports_with_kept_lineage(spark, sf):
    """Lineage kept between batches.  Commands come by time, their snapshots a batch later, the first commands
    twice; the stream begins again with a new checkpoint in between and reads every file once more."""
    path, log, snaps, state = (folder(spark, n) for n in ("reports", "log", "snapshots", "kept"))
    procs = cut_lineage(processes(spark, sf))
    whole = cut_lineage(raw_log(spark, sf).withColumns({"basename": basename(F.col("filename"))}))
    half = lambda time: (F.col(time) >= "2024-01-17").cast("int")
    part = lambda df, time, k: df.filter(half(time) == k)
    for arriving in ([(0, None), (1, 0)], [(0, 1)]):
        checkpoint = folder(spark, "state")
        for ran, listed in arriving:
            part(whole, "ts", ran).write.mode("append").parquet(log)
            write_process_snapshots(part(procs, "snapshot_ts", -1 if listed is None else listed), snaps)
            cmds = with_argv(read_command_log(spark, log, streaming=True))
            seen = read_process_snapshots(spark, snaps, streaming=True)
            stream_agent_audit(cmds, seen, lambda: context(spark, sf), path, state, checkpoint, _BACKLOG,
                               "0 seconds").awaitTermination()
    finish_agent_audit(spark, cmds, lambda: context(spark, sf), path, state)
    return _flat_reports(spark.read.parquet(path))


@query("x3_stream_daily_sink", """SELECT strftime(ts, '%Y-%m-%d') AS report_date, kind, count(*) AS n FROM x_reports
       WHERE event_id IN (SELECT event_id FROM x_inrow) GROUP BY ALL""")
def streamed_days(spark, sf):
    path = folder(spark, "reports")
    stream_reports_of(_log_stream(spark, sf), context(spark, sf), path, folder(spark, "state"), _BACKLOG,
                      _WHOLE).awaitTermination()
    return spark.read.parquet(path).groupBy(F.col("report_date").cast("string").alias("report_date"), "kind").agg(
        F.count("*").alias("n"))


@query("x4_stream_root_changes", f"SELECT {_ROW}, change FROM x_moves")
def streamed_changes(spark, sf):
    path, snaps = folder(spark, "changes"), folder(spark, "snapshots")
    _in_pieces(processes(spark, sf), "snapshot_ts", lambda df: write_process_snapshots(df, snaps))
    stream = read_process_snapshots(spark, snaps, streaming=True, per_batch=_files(spark))
    stream_root_changes(stream, path, folder(spark, "state"), _BACKLOG, _WHOLE).awaitTermination()
    return _named(read_root_changes(spark, path), "change")


@query("x_replays", "SELECT host, count(*) AS n FROM x_log0 GROUP BY host")
def replays(spark, sf):
    """Every command delivered twice is kept once."""
    path = folder(spark, "once")
    twice = spark.sql(COMMAND_SQL, events=_stream(spark, sf, "events"), commands=commands(spark))
    twice = twice.select("host", "pid", "ts", "filename", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    stream = (without_replays(twice, _WHOLE).writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", folder(spark, "state"))
              .outputMode("append").trigger(availableNow=True).start())
    stream.awaitTermination()
    return spark.read.parquet(path).groupBy("host").agg(F.count("*").alias("n"))
