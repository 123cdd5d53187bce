"""Audit tables derived from the given tables, by the same SQL rule in Spark and in DuckDB."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.catalogue import COMMANDS
from veilwatch.functions.argv import with_argv
from veilwatch.plans.dispatch import Context
from veilwatch.sources.policy import Policy, policy_from_text

HOME = "/home/u"
SEP = "\u001f"

POLICY_TEXT = """
# columns and tables of the given schema
block supplier
block vendor_contracts
mask  customer  c_name:email  c_acctbal:redact  c_mktsegment:partial:3
mask  orders    o_totalprice:redact  o_orderpriority:partial:1  o_custkey:phone

fblock /opt/vault/master.key
fblock /opt/vault/unseal/
fmask  /var/lib/billing/run?.csv
fblock ~/keys/backup.gpg
fblock ~/keys/*.pem
fmask  ~/.netrc
fmask  ~/.local/tokens/
fmask  credentials.ini
fmask  **/credentials.ini
fmask  **/wallet.dat
fmask  /srv/export/*
"""

_HOST = "'h' || CAST(CAST(floor({t}.event_id / 50) AS BIGINT) % 4 AS STRING)"

COMMAND_SQL = f"""
SELECT e.event_id, {_HOST.format(t='e')} AS host, CAST(e.ts AS TIMESTAMP) AS ts,
       e.event_id + 2 AS pid, e.event_id + 1 AS ppid, 1000 + e.user_id AS uid, 'sh' AS comm, c.filename,
       replace(replace(replace(c.argv, '<user>', CAST(e.user_id AS STRING)),
                       '<type>', e.event_type), '<id>', CAST(e.event_id AS STRING)) AS argv_text,
       CASE WHEN e.event_id % 37 <> 0 THEN '/home/u/app' END AS cwd
FROM {{events}} e JOIN {{commands}} c ON e.event_id % {len(COMMANDS)} = c.cmd_id
"""

# Chains of 50 processes; some are their own parent, some form a circle of two.
PROCESS_SQL = f"""
SELECT {_HOST.format(t='e')} AS host, CAST(date_trunc('day', CAST(e.ts AS TIMESTAMP)) AS TIMESTAMP) AS day,
       e.event_id % 3 AS more_days, e.event_id + 2 AS pid,
       CASE WHEN e.event_id % 97 = 0 THEN e.event_id + 2
            WHEN e.event_id % 89 = 0 THEN e.event_id + 3
            WHEN e.event_id % 50 = 0 THEN 1
            ELSE e.event_id + 1 END AS ppid,
       CASE WHEN e.event_id % 100 = 0 THEN ' Claude-main' WHEN e.event_id % 250 = 75 THEN 'claude'
            ELSE 'node' END AS comm,
       CASE WHEN e.event_id % 300 = 160 THEN 'node /x/@Anthropic-AI/CLAUDE/cli.js'
            WHEN e.event_id % 300 = 210 THEN 'node /x/anthropic/claude run'
            ELSE 'node /opt/' || e.event_type || '.js' END AS cmdline
FROM {{events}} e
"""

# Whole documents behind one of several statements, and whole pages under protected names.
CONTENT_SQL = """
SELECT 'h' || CAST(d.doc_id % 4 AS STRING) AS host,
       '/srv/sql/q' || CAST(d.doc_id AS STRING) || '.sql' AS path,
       CASE d.doc_id % 9
            WHEN 0 THEN 'DROP TABLE t' || CAST(d.doc_id AS STRING) || '; '
            WHEN 1 THEN 'SELECT c_name, c_acctbal FROM customer; '
            WHEN 2 THEN 'SELECT * FROM orders; '
            WHEN 3 THEN 'SHOW TABLES; EXPLAIN x; '
            WHEN 4 THEN 'SELECT s_name FROM supplier; '
            WHEN 5 THEN 'DELETE FROM t; GRANT a TO b; '
            WHEN 6 THEN 'SELECT o_custkey' || chr(10) || 'FROM orders; '
            WHEN 7 THEN '/* note */ -- more' || chr(10)
            ELSE '' END || d.text AS content, TIMESTAMP '1970-01-01 00:00:00' AS recorded_at
FROM {documents} d
UNION ALL
SELECT 'h' || CAST(p.page_id % 4 AS STRING) AS host,
       CASE p.page_id % 6
            WHEN 0 THEN '/home/u/.netrc'
            WHEN 1 THEN '/srv/p' || CAST(p.page_id AS STRING) || '/credentials.ini'
            WHEN 2 THEN '/srv/p' || CAST(p.page_id AS STRING) || '/wallet.dat'
            WHEN 3 THEN '/opt/vault/master.key'
            WHEN 4 THEN '/var/lib/billing/run' || CAST(p.page_id % 20 AS STRING) || '.csv'
            ELSE '/srv/p' || CAST(p.page_id AS STRING) || '/index.html' END AS path,
       p.html AS content, TIMESTAMP '1970-01-01 00:00:00' AS recorded_at
FROM {pages} p
"""

# Every document as a staged change, followed by a second file with all kinds of lines; behind the
# documents' ids one more commit each with an empty diff, a failed inspection and no files.
# Token-like text is put together here so that none is stored.
DIFF_SQL = """
SELECT d.doc_id AS event_id, d.source || '/d.txt,config/app.env' AS files_text,
         'diff --git a/x b/x' || chr(10) || '--- a/' || d.source || '/d.txt' || chr(10)
         || '+++ b/' || d.source || '/d' || CAST(d.doc_id AS STRING) || '.txt' || chr(10)
         || '@@ -1,3 +' || CAST(d.doc_id % 50 AS STRING) || ',9 @@ ctx' || chr(10)
         || CASE d.doc_id % 3 WHEN 0 THEN '+' WHEN 1 THEN ' ' ELSE '-' END
         || replace(d.text, chr(10),
                    chr(10) || CASE d.doc_id % 3 WHEN 0 THEN '+' WHEN 1 THEN ' ' ELSE '-' END)
         || chr(10) || '+++ b/config/app.env' || chr(13) || chr(10) || '+MODE=' || d.lang || chr(10)
         || '@@ -310 +318 @@ settings' || chr(10) || '-TOKEN=gh' || 'p_' || repeat('a1', 18) || chr(10)
         || '+TOKEN=gh' || 'p_' || repeat('b' || CAST(d.doc_id % 10 AS STRING), 18) || chr(10)
         || ' context' || chr(10) || '+++ odd' || chr(10) || chr(92) || ' No newline' || chr(10)
         || '@@ bad header' || chr(10) || '+key AK' || 'IA' || repeat('Z9', 8) || ' and xo' || 'xb-'
         || repeat('7', 12) || chr(10) || chr(10)
         || '@@ -1 +99999999999 @@' || chr(10) || '+api_key: "' || repeat('q', 10) || '"' || chr(13) || chr(10)
         || '@@ -9 +4294967295 @@' || chr(10) || '+u' || CAST(d.doc_id AS STRING) || '@mail.example.org'
         || chr(10) AS diff, CAST(NULL AS STRING) AS error
FROM {documents} d
UNION ALL SELECT d.doc_id + (SELECT max(doc_id) + 1 FROM {documents}) AS event_id, d.source AS files_text, '' AS diff, CAST(NULL AS STRING) AS error
FROM {documents} d
UNION ALL SELECT d.doc_id + 2 * (SELECT max(doc_id) + 1 FROM {documents}), d.source, '+x', 'exited 128: dubious ownership'
FROM {documents} d
UNION ALL SELECT d.doc_id + 3 * (SELECT max(doc_id) + 1 FROM {documents}), '', '', CAST(NULL AS STRING)
FROM {documents} d
"""

# Two candidate policy files per customer; some numbers make a file unacceptable.
POLICY_FILE_SQL = """
SELECT 'p' || CAST(c.c_custkey AS STRING) AS policy_id, 1 AS priority,
       '# policy of ' || c.c_name || chr(10) || chr(10)
       || '  block  Cards_' || CAST(c.c_nationkey AS STRING) || chr(10)
       || 'mask Users  Email:email  phone:phone  ssn:redact  code:partial:'
       || CAST(c.c_custkey % 300 AS STRING) || chr(13) || chr(10)
       || CASE WHEN c.c_custkey % 7 = 0 THEN 'deny x' WHEN c.c_custkey % 11 = 0 THEN 'mask'
               WHEN c.c_custkey % 13 = 0 THEN 'mask t name' WHEN c.c_custkey % 17 = 0 THEN 'mask t n:hash'
               ELSE 'block users' END || chr(10)
       || 'fblock /etc/' || c.c_mktsegment || '/' || chr(10) || 'fmask ~/.env.*' AS content
FROM {customer} c
UNION ALL
SELECT 'p' || CAST(c.c_custkey AS STRING) AS policy_id, 2 AS priority,
       'mask ' || c.c_mktsegment || ' name:partial:+2' || chr(10) || 'block cards' || chr(10)
       || 'block CARDS' || chr(10) || 'mask cards a:redact b:phone' || chr(10)
       || 'fmask **/n' || CAST(c.c_nationkey AS STRING) || '?.y*ml' || chr(10)
       || 'fblock ' || CASE WHEN c.c_custkey % 5 = 0 THEN '' ELSE '~' END || chr(10) AS content
FROM {customer} c
"""


# --- Spark ----------------------------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEYS = {"documents": "doc_id", "pages": "page_id", "events": "event_id", "conversations": "conv_id"}


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows need much work each, spread over the cores whatever its files look like."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism, _KEYS[name])


def _derive(spark, sf_dir, sql: str, *names: str, spread: bool = True, **more) -> DataFrame:
    read = lambda n: (spread_table if spread and n in _KEYS else table)(spark, sf_dir, n)
    return spark.sql(sql, **{n: read(n) for n in names}, **more)


def commands(spark: SparkSession) -> DataFrame:
    rows = [(i, f, SEP.join(argv)) for i, (f, argv) in enumerate(COMMANDS)]
    ids, files, argvs = zip(*rows)
    return spark.createDataFrame(pa.table({
        "cmd_id": pa.array(ids, pa.int64()), "filename": list(files), "argv": list(argvs)}))


def raw_log(spark, sf_dir) -> DataFrame:
    """The command log as recorded: command lines are NUL-separated bytes."""
    log = _derive(spark, sf_dir, COMMAND_SQL, "events", commands=commands(spark))
    return (log.withColumn("cmdline", F.replace("argv_text", F.lit(SEP), F.lit("\u0000")).cast("binary"))
            .drop("argv_text"))


def command_log(spark, sf_dir) -> DataFrame:
    return with_argv(raw_log(spark, sf_dir))


def processes(spark, sf_dir) -> DataFrame:
    """A process is seen on its day and up to two more; host h3 is scanned six hours later."""
    return processes_from(spark, spread_table(spark, sf_dir, "events"))


def processes_from(spark, events: DataFrame) -> DataFrame:
    base = spark.sql(PROCESS_SQL, events=events)
    return (base.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("more_days"))))
            .withColumn("snapshot_ts", F.expr(
                "day + make_dt_interval(cast(k as int), case when host = 'h3' then 6 else 0 end)"))
            .select("host", "snapshot_ts", "pid", "ppid", "comm", "cmdline"))


def file_contents(spark, sf_dir) -> DataFrame:
    return _derive(spark, sf_dir, CONTENT_SQL, "documents", "pages")


def commit_diffs(spark, sf_dir, spread: bool = True) -> DataFrame:
    """Not spread for an operator that deals the rows anew before it works on them."""
    diffs = _derive(spark, sf_dir, DIFF_SQL, "documents", spread=spread)
    files = F.filter(F.split("files_text", ","), lambda x: x != "")
    return diffs.select("event_id", F.timestamp_seconds(F.lit(0)).alias("recorded_at"), files.alias("files"),
                        "diff", "error")


def policy_files(spark, sf_dir) -> DataFrame:
    return _derive(spark, sf_dir, POLICY_FILE_SQL, "customer")


_loaded: dict[str, Policy] = {}


def policy(spark) -> Policy:
    """The sample policy, loaded once per process."""
    if POLICY_TEXT not in _loaded:
        _loaded[POLICY_TEXT] = policy_from_text(spark, POLICY_TEXT, HOME)
    return _loaded[POLICY_TEXT]


def context(spark, sf_dir) -> Context:
    return Context(file_contents(spark, sf_dir), commit_diffs(spark, sf_dir), policy(spark), HOME)


def exec_frames(spark, sf_dir) -> DataFrame:
    """Raw fixed-width records: some short, some without NUL, some not UTF-8."""
    text = f"""
    SELECT event_id, ts, {_HOST.format(t='e')} AS host, event_id + 2 AS pid, 1000 + user_id AS uid,
           CASE WHEN event_id % 10 = 0 THEN 'name-of-16-bytes' ELSE event_type END AS comm,
           '/usr/bin/' || event_type || CAST(user_id AS STRING) AS filename FROM {{events}} e"""
    df = _derive(spark, sf_dir, text, "events")

    def u32(c):
        digits = F.lpad(F.hex(c), 8, "0")
        return F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])

    bad = F.when(F.col("event_id") % 23 == 0, "FF").otherwise("")
    filename = F.concat(F.hex(F.col("filename").cast("binary")), bad)
    raw = F.concat(u32(F.col("pid")), u32(F.col("uid")),
                   F.rpad(F.hex(F.col("comm").cast("binary")), 32, "0"),
                   F.rpad(filename, 512, "0"))
    short = F.when(F.col("event_id") % 19 == 0, F.left(raw, F.lit(200))).otherwise(raw)
    return df.select("event_id", "host", "ts", F.unhex(short).alias("raw"))


# --- DuckDB ---------------------------------------------------------------------------------------

def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return f"CAST([{', '.join(quote(v) for v in value)}] AS VARCHAR[])"
    return "'" + value.replace("'", "''") + "'"


def values(columns: str, rows) -> str:
    body = ",\n".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


def _duck(sql: str) -> str:
    names = {n: n for n in ("events", "documents", "pages", "customer")}
    return sql.format(commands="x_commands", **names)


CTES = {
    "x_commands": values("cmd_id, filename, argv",
                       [(i, f, SEP.join(a)) for i, (f, a) in enumerate(COMMANDS)]),
    "x_log0": _duck(COMMAND_SQL),
    "x_log": f"""SELECT * FROM (SELECT * EXCLUDE (argv_text),
                list_filter(string_split(argv_text, '{SEP}'), lambda x: x <> '') AS argv,
                string_split(filename, '/')[-1] AS base FROM x_log0) WHERE len(argv) > 0""",
    "x_procs0": _duck(PROCESS_SQL),
    "x_procs": """SELECT host, day + to_days(CAST(k AS INTEGER))
                  + to_hours(CASE WHEN host = 'h3' THEN 6 ELSE 0 END) AS snapshot_ts,
                pid, ppid, comm, cmdline
                FROM (SELECT *, unnest(range(0, more_days + 1)) AS k FROM x_procs0)""",
    "x_contents": _duck(CONTENT_SQL),
    "x_diffs": _duck(DIFF_SQL),
    "x_policy_files": _duck(POLICY_FILE_SQL),
}


def oracle(sql: str) -> str:
    """The query with the common table expressions it needs, directly or through others."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(x_\w+)", text):
            if name in CTES and name not in order and name not in busy:
                busy.add(name)
                need(CTES[name])
                order.append(name)

    busy: set[str] = set()
    need(sql)
    ctes = ",\n".join(f"{name} AS {'' if name.endswith('walk') else 'MATERIALIZED '}({CTES[name]})" for name in order)
    return f"WITH RECURSIVE {ctes}\n{sql}" if ctes else sql
