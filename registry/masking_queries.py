"""Text and column masking, policy files, record decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import folder, joined, number, query
from registry.fixtures import (CTES, HOME, command_log, exec_frames, file_contents, policy,
                               policy_files, raw_log, spread_table, table)
from veilwatch.functions.globs import expand_home, glob_test
from veilwatch.functions.masking import (mask_column, mask_sql_text, mask_table, mask_text,
                                         secret_hits)
from veilwatch.functions.text import clip_bytes, snippet
from veilwatch.operators.text_pieces import cut_texts, mask_pieces
from veilwatch.plans.path_policy import mask_files
from veilwatch.rules.mask_rules import SQL_TEXT
from veilwatch.rules.text_rules import TEXT_RULES
from veilwatch.sources.exec_events import (decode_exec_events, decode_frames, read_command_log,
                                           read_exec_events, watchlist_filter, write_command_log)
from veilwatch.sources.policy import load_policies, parse_policy_lines, policy_summary


def _masked(column: str) -> str:
    out = column
    for rule in TEXT_RULES:
        pattern = rule.pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{pattern}', '{rule.label}', 'g')"
    return out


# --- S4, A9: policy files in SQL ------------------------------------------------------------------

_PCTES = {
    "x_plines": """SELECT policy_id, priority, pos AS line, string_split_regex(t, '\\s+') AS tok FROM (
        SELECT policy_id, priority, generate_subscripts(ls, 1) AS pos,
               regexp_replace(unnest(ls), '^\\s+|\\s+$', '', 'g') AS t
        FROM (SELECT *, string_split(CASE WHEN ends_with(content, chr(10))
                THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS ls FROM x_policy_files))
        WHERE t <> '' AND NOT starts_with(t, '#')""",
    "x_pspecs": """SELECT policy_id, priority, line, tok, pos, spec, lower(left(spec, instr(spec, ':') - 1)) AS name,
        CASE WHEN instr(spec, ':') > 0 THEN substr(spec, instr(spec, ':') + 1) END AS ks
        FROM (SELECT *, unnest(tok[3:]) AS spec, generate_subscripts(tok[3:], 1) AS pos
              FROM x_plines WHERE tok[1] IN ('block', 'mask'))""",
    "x_pkinds": """SELECT *, CASE WHEN ks IN ('redact', 'email', 'phone') THEN ks
          WHEN starts_with(ks, 'partial:') AND TRY_CAST(substr(ks, 9) AS INTEGER) BETWEEN 0 AND 255
          THEN 'partial' END AS kind, TRY_CAST(substr(ks, 9) AS INTEGER) AS n FROM x_pspecs""",
    "x_pbad": """SELECT policy_id, priority, line, CASE WHEN len(tok) < 2 THEN 'incomplete'
          WHEN tok[1] NOT IN ('block', 'mask', 'fblock', 'fmask') THEN 'unknown directive' END AS reason, 0 AS pos
        FROM x_plines UNION ALL
        SELECT policy_id, priority, line, CASE WHEN ks IS NULL THEN 'bad column spec'
          WHEN kind IS NULL THEN 'unknown mask kind' END, pos FROM x_pkinds""",
    "x_perrors": """SELECT policy_id, priority, arg_min(line, line * 1000 + pos) AS line,
          arg_min(reason, line * 1000 + pos) AS reason FROM x_pbad WHERE reason IS NOT NULL GROUP BY ALL""",
    "x_pwin": """SELECT policy_id, min(priority) AS priority FROM x_policy_files
        WHERE (policy_id, priority) NOT IN (SELECT (policy_id, priority) FROM x_perrors) GROUP BY policy_id""",
    "x_ptables": """SELECT policy_id, lower(tok[2]) AS name, arg_max(tok[1], line) AS mode, max(line) AS ord,
          any_value(priority) AS priority
        FROM x_plines JOIN x_pwin USING (policy_id, priority) WHERE tok[1] IN ('block', 'mask') GROUP BY ALL""",
    "x_pcolumns": """SELECT k.policy_id, t.name AS tname, k.name, k.kind,
          CASE WHEN k.kind = 'partial' THEN CAST(k.n AS VARCHAR) ELSE '' END AS n, k.pos AS col_ord
        FROM x_pkinds k JOIN x_ptables t ON k.policy_id = t.policy_id AND k.priority = t.priority AND k.line = t.ord""",
}

CTES.update(_PCTES)


# --- C14, C15: free text --------------------------------------------------------------------------

@query("c14_mask_documents", f"""
SELECT lang, count(*) AS n_docs, count(*) FILTER (m <> text) AS n_changed,
       CAST(sum(length(m)) AS BIGINT) AS n_chars, max(md5(m)) AS top_digest
FROM (SELECT lang, text, {_masked('text')} AS m FROM documents) GROUP BY lang""")
def mask_documents(spark, sf):
    docs = spread_table(spark, sf, "documents").select("lang", "text", mask_text(F.col("text")).alias("m"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("m") != F.col("text")).alias("n_changed"),
        F.sum(F.length("m")).alias("n_chars"), F.max(F.md5("m")).alias("top_digest"))


@query("c14_mask_pages", f"SELECT page_id, md5({_masked('html')}) AS digest FROM pages")
def mask_pages(spark, sf):
    return spread_table(spark, sf, "pages").select("page_id", F.md5(mask_text(F.col("html"))).alias("digest"))


@query("c14_mask_conversations",
       f"SELECT conv_id, turn, {_masked('text')} AS masked FROM conversations")
def mask_conversations(spark, sf):
    return spread_table(spark, sf, "conversations").select(
        "conv_id", "turn", mask_text(F.col("text")).alias("masked"))


# Token-like text for the provider rules, put together at run time.
_TOKENS = """'k=' || CAST(event_id AS STRING) || ' AK' || 'IA' || repeat('Q7', 8) || '; gh' || 'p_' || repeat('x1', 18)
 || ' github' || '_pat_' || repeat('b', 82) || ' gh' || 's_' || repeat('c', 36) || ' xo' || 'xp-' || repeat('1', 11)
 || ' AI' || 'za' || repeat('k-', 17) || 'z sk' || '_live_' || repeat('4', 24) || ' ey' || 'J' || repeat('a', 10)
 || '.' || repeat('b', 10) || '.' || repeat('c', 10) || ' -----BEGIN RSA PRIV' || 'ATE KEY-----' || chr(10) || event_type
 || chr(10) || '-----END RSA PRIV' || 'ATE KEY----- u' || CAST(user_id AS STRING) || '@x.io_b@y.org pass' || 'word: "' || props
 || '" TOK' || 'EN=gh' || 'p_' || repeat('z', 36) || ' ' || repeat('0f', 16)"""


@query("c14_mask_tokens", f"SELECT event_id, {_masked('t')} AS masked FROM (SELECT event_id, {_TOKENS} AS t FROM events)")
def mask_tokens(spark, sf):
    made = spread_table(spark, sf, "events").select("event_id", F.expr(_TOKENS).alias("t"))
    return made.select("event_id", mask_text(F.col("t")).alias("masked"))


# Every document with itself as a key block behind it, and half of them with a block that never ends.
_KEYED = """doc_id AS text_id, text || ' -----BEGIN EC PRIV' || 'ATE KEY-----' || chr(10) || text || chr(10)
 || '-----END EC PRIV' || 'ATE KEY-----' || text || CASE WHEN doc_id % 2 = 0 THEN '-----BEGIN RSA PRIV'
 || 'ATE KEY-----' || chr(10) || text ELSE '' END AS text"""


@query("c14_pieced_documents", f"""SELECT text_id, length(m) AS n_chars, md5(m) AS digest
FROM (SELECT text_id, {_masked('text')} AS m FROM (SELECT {_KEYED} FROM documents))""")
def mask_pieced_documents(spark, sf):
    """Documents stored in pieces that cut secrets and key blocks anywhere, masked over the borders."""
    made = table(spark, sf, "documents").selectExpr(*_KEYED.split(", ", 1))
    done = mask_pieces(cut_texts(made, 3000), 16).groupBy("text_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), "")
        .alias("m"))
    return done.select("text_id", F.length("m").alias("n_chars"), F.md5("m").alias("digest"))


def hits_sql(key: str, text: str, source: str) -> str:
    parts = []
    for i, rule in enumerate(TEXT_RULES, start=1):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT {key}, {i} AS ord, '{rule.kind}' AS kind, unnest(m) AS hit,
            generate_subscripts(m, 1) AS pos
            FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m FROM {source})""")
    union = " UNION ALL ".join(parts)
    return (f"SELECT {key}, kind, left(hit, least(12, length(hit) // 3)) || '...' AS snippet, sha256(hit) AS digest, "
            f"ord, pos FROM ({union})")


@query("c15_secret_hits", f"""
SELECT doc_id, kind, snippet, digest, count(*) AS n FROM ({hits_sql('doc_id', 'text', 'documents')})
GROUP BY ALL""")
def secrets_in_documents(spark, sf):
    docs = spread_table(spark, sf, "documents").select("doc_id", F.explode(secret_hits(F.col("text"))).alias("h"))
    return docs.groupBy("doc_id", "h.kind", "h.snippet", "h.digest").agg(F.count("*").alias("n"))


@query("c15_secret_kinds", f"""
SELECT event_id, string_agg(kind || '=' || snippet, ' | ' ORDER BY ord, pos) AS hits
FROM ({hits_sql('event_id', 't', f'(SELECT event_id, {_TOKENS} AS t FROM events)')}) GROUP BY event_id""")
def secret_kinds(spark, sf):
    made = spread_table(spark, sf, "events").select("event_id", F.expr(_TOKENS).alias("t"))
    hits = F.transform(secret_hits(F.col("t")), lambda h: F.concat(h["kind"], F.lit("="), h["snippet"]))
    return made.select("event_id", joined(hits).alias("hits"))


# --- C1 to C6: column masks -----------------------------------------------------------------------

@query("c1_redact", "SELECT c_custkey, '[REDACTED]' AS c_acctbal FROM customer")
def redact(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", mask_column(F.col("c_acctbal"), "redact").alias("c_acctbal"))


@query("c2_email", """SELECT c_custkey, left(c_name, 1) || '***@***.***' AS c_name,
       left(nullif(c_mktsegment, 'BUILDING'), 1) || '***@***.***' AS c_segment FROM customer""")
def email(spark, sf):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(spark, sf, "customer").select(
        "c_custkey", mask_column(F.col("c_name"), "email").alias("c_name"),
        mask_column(segment, "email").alias("c_segment"))


@query("c3_phone", """SELECT o_orderkey, '***-**-' || right(CAST(o_custkey AS VARCHAR), 4) AS o_custkey
       FROM orders""")
def phone(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", mask_column(F.col("o_custkey"), "phone").alias("o_custkey"))


@query("c4_partial", """SELECT s_suppkey, left(s_name, 5) || '***' AS s_name,
       left(CAST(s_nationkey AS VARCHAR), 0) || '***' AS s_nationkey FROM supplier""")
def partial(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey", mask_column(F.col("s_name"), "partial", 5).alias("s_name"),
        mask_column(F.col("s_nationkey"), "partial", 0).alias("s_nationkey"))


@query("c5_mask_table", """SELECT c_custkey, left(c_name, 1) || '***@***.***' AS c_name, c_nationkey,
       '[REDACTED]' AS c_acctbal, left(c_mktsegment, 3) || '***' AS c_mktsegment
       FROM customer""")
def masked_customer(spark, sf):
    return mask_table(table(spark, sf, "customer"), "customer", policy(spark))


@query("c5_mask_orders", """SELECT o_orderkey, '***-**-' || right(CAST(o_custkey AS VARCHAR), 4) AS o_custkey,
       '[REDACTED]' AS o_totalprice, left(o_orderpriority, 1) || '***' AS o_orderpriority FROM orders""")
def masked_orders(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return mask_table(df, "orders", policy(spark))


@query("c6_mask_sql", """
SELECT policy_id, col_ord, dialect,
       CASE WHEN kind = 'redact' THEN '''[REDACTED]'''
            WHEN kind = 'email' AND dialect = 'postgres' THEN '(left(' || name || '::text, 1) || ''***@***.***'')'
            WHEN kind = 'email' THEN 'CONCAT(LEFT(' || name || ', 1), ''***@***.***'')'
            WHEN kind = 'phone' AND dialect = 'postgres' THEN '(''***-**-'' || right(' || name || '::text, 4))'
            WHEN kind = 'phone' THEN 'CONCAT(''***-**-'', RIGHT(' || name || ', 4))'
            WHEN dialect = 'postgres' THEN '(left(' || name || '::text, ' || n || ') || ''***'')'
            ELSE 'CONCAT(LEFT(' || name || ', ' || n || '), ''***'')' END || ' AS ' || name AS text
FROM x_pcolumns, (VALUES ('postgres'), ('mysql'), ('sqlite')) AS d(dialect)""")
def mask_sql(spark, sf):
    cols = load_policies(policy_files(spark, sf), HOME).columns
    dialect = F.explode(F.array(*[F.lit(d) for d in ("postgres", "mysql", "sqlite")]))
    text = None
    for kind, dia in SQL_TEXT:
        template = mask_sql_text("<c>", kind, "<n>", dia)
        filled = F.replace(F.replace(F.lit(template), F.lit("<c>"), F.col("column")), F.lit("<n>"),
                           F.coalesce(F.col("n").cast("string"), F.lit("")))
        test = (F.col("kind") == kind) & (F.col("dialect") == dia)
        text = F.when(test, filled) if text is None else text.when(test, filled)
    return (cols.withColumn("dialect", dialect)
            .select("policy_id", number(F.col("col_ord")).alias("col_ord"), "dialect", text.alias("text")))


# --- S4, A9: policy files -------------------------------------------------------------------------

@query("s4_policy_tables", 'SELECT policy_id, name AS "table", mode, ord FROM x_ptables')
def policy_tables(spark, sf):
    t = load_policies(policy_files(spark, sf), HOME).tables
    return t.select("policy_id", "table", "mode", number(F.col("ord")).alias("ord"))


@query("s4_policy_columns", 'SELECT policy_id, tname AS "table", name AS "column", kind, n, col_ord FROM x_pcolumns')
def policy_columns(spark, sf):
    c = load_policies(policy_files(spark, sf), HOME).columns
    return c.select("policy_id", "table", "column", "kind",
                    F.coalesce(F.col("n").cast("string"), F.lit("")).alias("n"),
                    number(F.col("col_ord")).alias("col_ord"))


@query("s4_policy_paths", """
SELECT policy_id, line AS ord, tok[2] AS raw, replace(tok[2], '~', '/home/u') AS expanded,
       CASE WHEN ends_with(tok[2], '/') THEN '(?s)^(?:' || rtrim(tok[2], '/') || '|' || tok[2] || '.*)\\z'
            ELSE '(?s)^' || replace(replace(replace(replace(replace(replace(tok[2], '~', '/home/u'), '.', '\\.'),
                 '**', chr(1)), '*', '[^/]*'), '?', '.'), chr(1), '.*') || '\\z' END AS regex,
       tok[1][2:] AS mode
FROM x_plines JOIN x_pwin USING (policy_id, priority) WHERE tok[1] IN ('fblock', 'fmask')""")
def policy_paths(spark, sf):
    p = load_policies(policy_files(spark, sf), HOME).paths
    return p.select("policy_id", number(F.col("ord")).alias("ord"), "raw", "expanded", "regex", "mode")


@query("s4_policy_errors", "SELECT policy_id, CAST(priority AS BIGINT) AS priority, line, reason FROM x_perrors")
def policy_errors(spark, sf):
    e = load_policies(policy_files(spark, sf), HOME).errors
    return e.select("policy_id", number(F.col("priority")).alias("priority"),
                    number(F.col("line")).alias("line"), "reason")


@query("s4_policy_lines", """SELECT policy_id, CAST(priority AS BIGINT) AS priority,
       string_agg(line || ':' || array_to_string(tok, ' '), ' | ' ORDER BY line) AS rules
       FROM x_plines GROUP BY ALL""")
def policy_lines(spark, sf):
    lines = F.transform("rules", lambda r: F.concat(
        r["line"].cast("string"), F.lit(":"), F.array_join(r["tokens"], " ")))
    return parse_policy_lines(policy_files(spark, sf)).select(
        "policy_id", number(F.col("priority")).alias("priority"), joined(lines).alias("rules"))


@query("a9_policy_summary", """
SELECT policy_id, count(DISTINCT CASE WHEN tok[1] IN ('block', 'mask') THEN lower(tok[2]) END) AS n_tables,
       count(*) FILTER (tok[1] IN ('fblock', 'fmask')) AS n_paths
FROM x_plines JOIN x_pwin USING (policy_id, priority) GROUP BY policy_id""")
def summary(spark, sf):
    return policy_summary(load_policies(policy_files(spark, sf), HOME))


# --- C16, C17, G3b: paths and files ---------------------------------------------------------------

_GLOBS = ["/srv/sql/*.sql", "/srv/*", "/srv/**", "**/q1?.sql", "/srv/sql/", "/opt/vault/master.key", "/home/u/*",
          "/var/lib/billing/run?.csv", "**/wal*t.dat"]


@query("c16_glob", """
SELECT host, path,
  CASE WHEN regexp_matches(path, '^/srv/sql/[^/]*\\.sql$') THEN 1 ELSE 0 END
  || '' || CASE WHEN regexp_matches(path, '^/srv/[^/]*$') THEN 1 ELSE 0 END
  || '' || CASE WHEN starts_with(path, '/srv/') THEN 1 ELSE 0 END
  || '' || CASE WHEN regexp_matches(path, '/q1.\\.sql$') THEN 1 ELSE 0 END
  || '' || CASE WHEN path = '/srv/sql' OR starts_with(path, '/srv/sql/') THEN 1 ELSE 0 END
  || '' || CASE WHEN path = '/opt/vault/master.key' THEN 1 ELSE 0 END
  || '' || CASE WHEN path LIKE '/home/u/%' AND instr(substr(path, 9), '/') = 0 THEN 1 ELSE 0 END
  || '' || CASE WHEN regexp_matches(path, '^/var/lib/billing/run.\\.csv$') THEN 1 ELSE 0 END
  || '' || CASE WHEN regexp_matches(path, '/wal[^/]*t\\.dat$') THEN 1 ELSE 0 END AS flags,
  count(*) AS n
FROM x_contents GROUP BY ALL""")
def globs(spark, sf):
    flags = F.concat(*[glob_test(F.col("path"), g).cast("int").cast("string") for g in _GLOBS])
    return (file_contents(spark, sf).groupBy("host", "path").agg(F.count("*").alias("n"))
            .withColumn("flags", flags))


@query("c17_home", """
SELECT doc_id, CASE WHEN p = '~' OR starts_with(p, '~/') THEN '/home/u' || p[2:] ELSE p END AS expanded
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '~/' || source WHEN 1 THEN '~' WHEN 2 THEN '~' || source
      ELSE '/x/~/' || source END AS p FROM documents)""")
def home_paths(spark, sf):
    made = table(spark, sf, "documents").select("doc_id", F.expr(
        "CASE doc_id % 4 WHEN 0 THEN '~/' || source WHEN 1 THEN '~' WHEN 2 THEN '~' || source "
        "ELSE '/x/~/' || source END").alias("p"))
    return made.select("doc_id", expand_home(F.col("p"), F.lit(HOME)).alias("expanded"))


@query("g3b_mask_files", f"""
SELECT host, path, md5({_masked('content')}) AS digest FROM x_contents
WHERE path = '/home/u/.netrc' OR path LIKE '%/credentials.ini' OR path LIKE '%/wallet.dat'
   OR regexp_matches(path, '^/var/lib/billing/run.\\.csv$')""")
def masked_files(spark, sf):
    done = mask_files(file_contents(spark, sf), policy(spark))
    return done.select("host", "path", F.md5("content").alias("digest"))


# --- F8, F8b: cut text ----------------------------------------------------------------------------

_SPACES = " || ".join(f"chr({c})" for c in (
    9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_PADDED = """CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN chr(9) || ' ' || text || chr(10) || ' '
  WHEN 2 THEN chr(13) || chr(10) || left(text, 60) || chr(9) ELSE chr(12) || left(text, 100) || chr(11) END"""


@query("f8_snippet", f"""SELECT doc_id, CASE WHEN length(t) > 100 THEN left(t, 100) || '...' ELSE t END AS snippet
       FROM (SELECT doc_id, trim({_PADDED}, {_SPACES}) AS t FROM documents)""")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", snippet(F.expr(_PADDED), 100).alias("snippet"))


@query("f8b_clip_bytes", """SELECT doc_id, left(text, list_max(list_filter(range(0, 53),
       lambda k: strlen(left(text, k)) <= 52))) AS clipped FROM documents""")
def clipped(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clip_bytes(F.col("text"), 52).alias("clipped"))


# --- S1, S2, F1, F2: records ----------------------------------------------------------------------

_EXEC = """SELECT event_id, 'h' || CAST(CAST(floor(event_id / 50) AS BIGINT) % 4 AS VARCHAR) AS host,
  event_id + 2 AS pid, 1000 + user_id AS uid,
  CASE WHEN event_id % 10 = 0 THEN 'name-of-16-bytes' ELSE event_type END AS comm,
  CASE WHEN event_id % 23 = 0 THEN '' ELSE '/usr/bin/' || event_type || user_id END AS filename
  FROM events WHERE event_id % 19 <> 0"""


@query("s1_exec_frames", f"SELECT host, count(*) AS n, CAST(sum(pid) AS BIGINT) AS pids, "
                         f"CAST(sum(uid) AS BIGINT) AS uids FROM ({_EXEC}) GROUP BY host")
def frames(spark, sf):
    path = folder(spark, "frames")
    exec_frames(spark, sf).select("host", "ts", "raw").write.parquet(path)
    return _frame_counts(read_exec_events(spark, path, raw=True))


@query("s1_stream_frames", f"SELECT host, count(*) AS n, CAST(sum(pid) AS BIGINT) AS pids, "
                           f"CAST(sum(uid) AS BIGINT) AS uids FROM ({_EXEC}) GROUP BY host")
def streamed_frames(spark, sf):
    path, out = folder(spark, "frames"), folder(spark, "decoded")
    exec_frames(spark, sf).select("host", "ts", "raw").write.parquet(path)
    events = read_exec_events(spark, path, streaming=True, raw=True, per_batch=2)
    (events.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "state"))
     .trigger(availableNow=True).start().awaitTermination())
    return _frame_counts(spark.read.parquet(out))


def _frame_counts(df):
    return df.groupBy("host").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"),
                                  F.sum("uid").alias("uids"))


@query("s2_decode_exec_events", f"SELECT *, string_split(filename, '/')[-1] AS basename FROM ({_EXEC})")
def decoded(spark, sf):
    df = decode_exec_events(decode_frames(exec_frames(spark, sf)))
    return df.select("event_id", "host", "pid", "uid", "comm", "filename", "basename")


@query("f1_watchlist", """SELECT base AS program, count(*) AS n FROM
  (SELECT string_split(filename, '/')[-1] AS base FROM x_log0)
  WHERE base IN ('git', 'psql', 'mysql', 'mariadb', 'sqlite3', 'redis-cli', 'npm', 'pip', 'pip3', 'curl', 'wget',
    'docker', 'kubectl', 'cat', 'head', 'tail', 'grep', 'egrep', 'fgrep', 'diff', 'find', 'cp', 'mv')
  GROUP BY base""")
def watchlist(spark, sf):
    """The stored log, read back by its reader."""
    path = folder(spark, "log")
    write_command_log(raw_log(spark, sf), path)
    kept = watchlist_filter(read_command_log(spark, path))
    return kept.groupBy(F.substring_index("filename", "/", -1).alias("program")).agg(F.count("*").alias("n"))


@query("f2_argv", "SELECT event_id, len(argv) AS n, array_to_string(argv, ' | ') AS argv FROM x_log")
def argvs(spark, sf):
    return command_log(spark, sf).select("event_id", number(F.size("argv")).alias("n"),
                                         joined("argv").alias("argv"))
