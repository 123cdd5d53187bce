"""SQL text: normalising, statements, findings, referenced tables, table policy, SQL guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import flat_verdicts, folder, joined, joined_some, number, query
from registry.command_queries import VERDICT
from registry.fixtures import (CTES, HOME, command_log, commit_diffs, context, file_contents, policy,
                               policy_files, quote, spread_table, table, values)
from veilwatch.functions.sqltext import (block_findings, dedup_consecutive, normalise_sql,
                                         query_findings, selects_star, stacked_statement,
                                         statements, table_refs, warn_details, with_sql_analysis)
from veilwatch.functions.text import strings
from veilwatch.plans.actions import match_action
from veilwatch.plans.dispatch import Context, audit
from veilwatch.plans.path_policy import lookup_path_policy
from veilwatch.plans.sql_audit import (first_protected, lookup_table_policy,
                                       policy_outcome, with_sql_facts, with_sql_sources)
from veilwatch.rules import sql_rules as R
from veilwatch.rules.threat_texts import UNSEEN_SQL
from veilwatch.sources.contents import (COMMIT_DIFFS_SCHEMA, FILE_CONTENTS_SCHEMA, attach_diffs,
                                        attach_sql_files, read_commit_diffs, read_file_contents)
from veilwatch.sources.policy import load_policies

_RANKS = {c: i for i, (c, _) in enumerate(R.CATEGORY_PRIORITY, start=1)}
_CODES = [(i, c, code) for i, (c, code) in enumerate(R.CATEGORY_PRIORITY, start=1)]

_SNIP = "CASE WHEN length(stmt) > 100 THEN left(stmt, 100) || '...' ELSE stmt END"


def _rule_branches(n: str) -> str:
    """One branch per rule, so that every pattern is a constant."""
    return " UNION ALL ".join(
        f"SELECT k, pos, {r.ord} AS ord, {r.block} AS block, {_RANKS.get(r.category) or 'NULL'} AS rank, "
        f"{quote(r.name + ' -- `')} || {_SNIP} || '`' AS detail FROM {n}_stmt "
        f"WHERE regexp_matches(stmt, {quote(r.pattern)})" for r in R.SQL_RULES)


def _audit_ctes(name: str, source: str) -> dict[str, str]:
    """Normalise, split, test and rank the SQL of ``source(k, sql)``; ends in ``<name>_analysis``."""
    n = name
    return {
        f"{n}_norm": f"""SELECT k, trim(regexp_replace(regexp_replace(regexp_replace(sql, '/\\*[\\s\\S]*?\\*/', ' ', 'g'),
            '--[^\\n]*', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM {source} WHERE sql IS NOT NULL""",
        f"{n}_stmt": f"""SELECT k, pos, stmt FROM (SELECT k, generate_subscripts(p, 1) AS pos, trim(unnest(p)) AS stmt
            FROM (SELECT k, string_split(norm, ';') AS p FROM {n}_norm)) WHERE stmt <> ''""",
        f"{n}_found": f"""
            {_rule_branches(n)}
            UNION ALL SELECT k, pos, 34, TRUE, {_RANKS['Destructive']}, '{R.DELETE_WITHOUT_WHERE} -- `' || {_SNIP} || '`'
            FROM {n}_stmt WHERE regexp_matches(stmt, '(?i)\\bDELETE\\s+FROM\\b') AND NOT regexp_matches(stmt, '(?i)\\bWHERE\\b')
            UNION ALL SELECT k, pos, 35, TRUE, {_RANKS['Destructive']}, '{R.UPDATE_WITHOUT_WHERE} -- `' || {_SNIP} || '`'
            FROM {n}_stmt WHERE regexp_matches(stmt, '(?i)\\bUPDATE\\s+\\w[\\w.]*\\s+SET\\b')
              AND NOT regexp_matches(stmt, '(?i)\\bWHERE\\b')""",
        f"{n}_warn": f"""SELECT k, string_agg(detail, ' | ' ORDER BY pos, ord) AS details FROM (
            SELECT *, lag(detail) OVER (PARTITION BY k ORDER BY pos, ord) AS before FROM {n}_found WHERE NOT block)
            WHERE detail IS DISTINCT FROM before GROUP BY k""",
        f"{n}_top": f"SELECT k, min(rank) AS rank FROM {n}_found WHERE block GROUP BY k",
        f"{n}_block": f"""SELECT t.k, t.rank, string_agg(detail, ' | ' ORDER BY pos, ord) AS details
            FROM {n}_top t JOIN {n}_found f ON f.k = t.k AND f.block AND f.rank = t.rank GROUP BY ALL""",
        f"{n}_analysis": f"""SELECT n.k, CASE WHEN b.k IS NOT NULL THEN 'Dangerous' WHEN w.k IS NOT NULL THEN 'Suspicious'
              ELSE 'Clean' END AS level, c.category,
            CASE WHEN b.k IS NOT NULL THEN c.code WHEN w.k IS NOT NULL THEN 'SQL_SUSPICIOUS' END AS code,
            CASE WHEN b.k IS NOT NULL THEN b.details ELSE coalesce(w.details, '') END AS details
            FROM {n}_norm n LEFT JOIN {n}_block b ON b.k = n.k LEFT JOIN {n}_warn w ON w.k = n.k
            LEFT JOIN x_catcodes c ON c.rank = b.rank""",
    }


_LABEL = "CASE tool WHEN 'mariadb' THEN 'mysql' ELSE tool END"
_POLICY_TABLES = [("customer", "mask", "c_name | c_acctbal | c_mktsegment"),
                  ("orders", "mask", "o_totalprice | o_orderpriority | o_custkey"),
                  ("vendor_contracts", "block", ""), ("supplier", "block", "")]

_AT = ("CASE WHEN instr(u, ' FROM ') > 0 THEN instr(u, ' FROM ') WHEN instr(u, chr(10) || 'FROM ') > 0 "
       "THEN instr(u, chr(10) || 'FROM ') ELSE instr(u, chr(9) || 'FROM ') END")


def _head_sql(col: str, tab: str, pg: str) -> str:
    """The head with the sample policy's columns replaced in order; ``pg`` tests for that dialect."""
    def sub(inner, name, pg_text, other):
        return (f"regexp_replace({inner}, '\\b{name}\\b', CASE WHEN {pg} THEN '{pg_text}' ELSE '{other}' END, 'gi')")
    customer = sub(sub(sub(col, "c_name", "(left(c_name::text, 1) || ''***@***.***'') AS c_name",
                           "CONCAT(LEFT(c_name, 1), ''***@***.***'') AS c_name"),
                       "c_acctbal", "''[REDACTED]'' AS c_acctbal", "''[REDACTED]'' AS c_acctbal"),
                   "c_mktsegment", "(left(c_mktsegment::text, 3) || ''***'') AS c_mktsegment",
                   "CONCAT(LEFT(c_mktsegment, 3), ''***'') AS c_mktsegment")
    orders = sub(sub(sub(col, "o_totalprice", "''[REDACTED]'' AS o_totalprice", "''[REDACTED]'' AS o_totalprice"),
                     "o_orderpriority", "(left(o_orderpriority::text, 1) || ''***'') AS o_orderpriority",
                     "CONCAT(LEFT(o_orderpriority, 1), ''***'') AS o_orderpriority"),
                 "o_custkey", "(''***-**-'' || right(o_custkey::text, 4)) AS o_custkey",
                 "CONCAT(''***-**-'', RIGHT(o_custkey, 4)) AS o_custkey")
    return f"CASE {tab} WHEN 'customer' THEN {customer} WHEN 'orders' THEN {orders} END"


CTES.update({
    "x_catcodes": values("rank, category, code", _CODES),
    "x_ptab": values("tname, mode, columns", _POLICY_TABLES),

    # the SQL of commands, as the audit and as the policy see it
    "x_subargv": """SELECT event_id, argv[list_position(argv, '--') + 1:] AS sub FROM x_log
        WHERE base = 'kubectl' AND list_contains(argv[2:], 'exec') AND list_contains(argv, '--')""",
    "x_subtool": """SELECT event_id, sub, string_split(sub[1], '/')[-1] AS inner_tool FROM x_subargv
        WHERE string_split(sub[1], '/')[-1] IN ('psql', 'mysql', 'mariadb', 'sqlite3')""",
    "x_subtok": """SELECT event_id, inner_tool, sub, unnest(sub) AS tok, generate_subscripts(sub, 1) AS i FROM x_subtool""",
    "x_subhit": """SELECT event_id, kind, v FROM (SELECT s.event_id, f.kind,
          CASE WHEN tok = flag THEN sub[i + 1] ELSE substr(tok, length(flag) + 2) END AS v,
          row_number() OVER (PARTITION BY s.event_id, f.kind ORDER BY i) AS rn
        FROM x_subtok s JOIN x_toolflags f ON f.tool = s.inner_tool AND (tok = flag OR starts_with(tok, flag || '=')))
        WHERE rn = 1""",
    "x_subpos": """SELECT event_id, CASE WHEN inner_tool = 'sqlite3' AND len(p) >= 2 THEN p[-1] END AS v FROM (
        SELECT *, list_filter(sub[2:], lambda x: NOT starts_with(x, '-')) AS p FROM x_subtool)""",
    "x_subsrc": """SELECT t.event_id, CASE WHEN a.v IS NOT NULL THEN 'inline' WHEN b.v IS NOT NULL THEN 'file'
          WHEN p.v IS NOT NULL THEN 'inline' END AS kind, coalesce(a.v, b.v, p.v) AS v
        FROM x_subtool t LEFT JOIN x_subhit a ON a.event_id = t.event_id AND a.kind = 'sql'
        LEFT JOIN x_subhit b ON b.event_id = t.event_id AND b.kind = 'file' LEFT JOIN x_subpos p ON p.event_id = t.event_id""",
    "x_asql": """SELECT m.event_id AS k, CASE s.kind WHEN 'inline' THEN s.v ELSE c.content END AS sql
        FROM x_matched m JOIN (SELECT * FROM x_auditsrc UNION ALL SELECT * FROM x_subsrc) s ON s.event_id = m.event_id
        LEFT JOIN x_contents c ON s.kind = 'file' AND c.host = m.host AND c.path = s.v
        WHERE m.guard IN ('sql', 'cluster')""",
    "x_psql": """SELECT m.event_id AS k, m.tool, CASE s.kind WHEN 'inline' THEN s.v ELSE c.content END AS sql
        FROM x_matched m JOIN x_policysrc s ON s.event_id = m.event_id
        LEFT JOIN x_contents c ON s.kind = 'file' AND c.host = m.host AND c.path = s.v
        WHERE m.guard = 'sql'""",
    **_audit_ctes("x_a", "x_asql"),

    "x_docsql": "SELECT path AS k, content AS sql FROM x_contents WHERE path LIKE '/srv/sql/%'",
    **_audit_ctes("x_d", "x_docsql"),

    "x_refs": """SELECT DISTINCT k, lower(r) AS ref FROM (
        SELECT k, unnest(regexp_extract_all(sql, '(?i)\\bFROM\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)) AS r FROM x_psql UNION ALL
        SELECT k, unnest(regexp_extract_all(sql, '(?i)\\bJOIN\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)) FROM x_psql UNION ALL
        SELECT k, unnest(regexp_extract_all(sql, '(?i)\\bUPDATE\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)) FROM x_psql UNION ALL
        SELECT k, unnest(regexp_extract_all(sql, '(?i)\\bINTO\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)) FROM x_psql)""",
    "x_firsttab": """SELECT k, tname, mode, columns FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY mode, tname) AS rn
        FROM x_refs JOIN x_ptab ON ref = tname) WHERE rn = 1""",
    "x_g2": f"""SELECT m.event_id, m.action, CASE WHEN t.k IS NULL THEN 'Allow' ELSE 'Block' END AS verdict,
          coalesce(t.mode = 'mask' AND NOT regexp_matches(p.sql, '(?i)\\bSELECT\\s+\\*'), FALSE) AS masked,
          CASE WHEN t.mode = 'mask' AND NOT regexp_matches(p.sql, '(?i)\\bSELECT\\s+\\*') THEN 'DATA_POLICY_MASKED'
               WHEN t.k IS NOT NULL THEN 'DATA_POLICY_BLOCK' END AS code,
          CASE WHEN t.k IS NOT NULL THEN {_LABEL.replace('tool', 'm.tool')} END AS tool, t.tname AS subject, t.columns AS details,
          CAST(NULL AS VARCHAR) AS inner_code
        FROM x_matched m LEFT JOIN x_psql p ON p.k = m.event_id LEFT JOIN x_firsttab t ON t.k = m.event_id
        WHERE m.guard = 'sql'""",
    "x_g1": f"""SELECT m.event_id, m.action, CASE a.level WHEN 'Dangerous' THEN 'Block' WHEN 'Suspicious' THEN 'Warn'
          ELSE 'Allow' END AS verdict, FALSE AS masked, a.code,
          CASE WHEN a.code IS NOT NULL THEN {_LABEL.replace('tool', 'm.tool')} END AS tool, CAST(NULL AS VARCHAR) AS subject,
          CASE WHEN a.code IS NOT NULL THEN a.details END AS details, CAST(NULL AS VARCHAR) AS inner_code
        FROM x_matched m LEFT JOIN x_a_analysis a ON a.k = m.event_id WHERE m.guard = 'sql'""",
    "x_sql": """SELECT * FROM x_g2 WHERE verdict <> 'Allow'
        UNION ALL SELECT * FROM x_g1 WHERE event_id IN (SELECT event_id FROM x_g2 WHERE verdict = 'Allow')""",
    "x_cluster": f"""SELECT m.event_id, m.action, CASE WHEN t.event_id IS NULL OR a.level = 'Clean' THEN 'Allow' ELSE 'Block' END
            AS verdict, FALSE AS masked,
          CASE WHEN t.event_id IS NULL OR a.level = 'Clean' THEN NULL ELSE 'KUBECTL_SQL_THREAT' END AS code,
          CASE WHEN t.event_id IS NULL OR a.level = 'Clean' THEN NULL ELSE t.inner_tool END AS tool,
          CASE WHEN t.event_id IS NULL OR a.level = 'Clean' THEN NULL ELSE p.pod END AS subject,
          CASE WHEN t.event_id IS NULL OR a.level = 'Clean' THEN NULL
               ELSE coalesce(a.details, replace('{UNSEEN_SQL.replace("'", "''")}', '<tool>', t.inner_tool)) END AS details,
          CASE WHEN t.event_id IS NULL OR a.level = 'Clean' THEN NULL ELSE coalesce(a.code, 'SQL_DESTRUCTIVE') END AS inner_code
        FROM x_matched m LEFT JOIN x_subtool t USING (event_id) LEFT JOIN x_pod p USING (event_id)
        LEFT JOIN x_a_analysis a ON a.k = m.event_id WHERE m.guard = 'cluster'""",
})


def _doc_sql(spark, sf):
    """SQL files made of whole documents."""
    files = file_contents(spark, sf).filter(F.col("path").startswith("/srv/sql/"))
    return files.select("path", F.col("content").alias("sql"))


# --- C9 to C13, A1 to A3 over whole documents -----------------------------------------------------

@query("c9_normalise", "SELECT k AS path, md5(norm) AS digest, length(norm) AS n FROM x_d_norm")
def normalised(spark, sf):
    norm = normalise_sql(F.col("sql"))
    return _doc_sql(spark, sf).select("path", F.md5(norm).alias("digest"), number(F.length(norm)).alias("n"))


@query("c10_statements", """SELECT k AS path, row_number() OVER (PARTITION BY k ORDER BY pos) AS nth,
       md5(stmt) AS digest FROM x_d_stmt""")
def split_statements(spark, sf):
    parts = F.posexplode(statements(normalise_sql(F.col("sql")))).alias("pos", "stmt")
    return _doc_sql(spark, sf).select("path", parts).select(
        "path", (number(F.col("pos")) + 1).alias("nth"), F.md5("stmt").alias("digest"))


def _found(spark, sf):
    return _doc_sql(spark, sf).withColumn("n", normalise_sql(F.col("sql"))).withColumn("f", query_findings("n"))


@query("c11_block_rules", """SELECT k AS path, string_agg(detail, ' | ' ORDER BY pos, ord) AS findings
       FROM x_d_found WHERE block AND ord <= 33 GROUP BY k""")
def block_rules(spark, sf):
    ours = F.filter(block_findings(F.col("f")), lambda x: ~(
        x["detail"].startswith(R.DELETE_WITHOUT_WHERE) | x["detail"].startswith(R.UPDATE_WITHOUT_WHERE)))
    df = _found(spark, sf).withColumn("b", F.transform(ours, lambda x: x["detail"]))
    return df.select("path", joined_some("b").alias("findings"))


@query("c12_warn_rules", """SELECT k AS path, string_agg(detail, ' | ' ORDER BY pos, ord) AS findings
       FROM x_d_found WHERE NOT block GROUP BY k""")
def warn_rules(spark, sf):
    warns = F.filter("f", lambda x: ~x["block"])
    df = _found(spark, sf).withColumn("w", F.transform(warns, lambda x: x["detail"]))
    return df.select("path", joined_some("w").alias("findings"))


@query("c13_no_where", """SELECT k AS event_id, string_agg(detail, ' | ' ORDER BY pos, ord) AS findings
       FROM x_a_found WHERE ord > 33 GROUP BY k""")
def no_where(spark, sf):
    df = _command_sql(spark, sf).withColumn("n", normalise_sql(F.col("sql"))).withColumn("f", query_findings("n"))
    ours = F.filter("f", lambda x: x["detail"].startswith(R.DELETE_WITHOUT_WHERE)
                    | x["detail"].startswith(R.UPDATE_WITHOUT_WHERE))
    return df.withColumn("d", F.transform(ours, lambda x: x["detail"])).select(
        "event_id", joined_some("d").alias("findings"))


@query("a1_top_category", """SELECT k AS path, category, code, details FROM x_d_analysis WHERE level = 'Dangerous'""")
def top_category(spark, sf):
    df = with_sql_analysis(_doc_sql(spark, sf), "sql", "a").filter("a.level = 'Dangerous'")
    return df.select("path", "a.category", "a.code", joined("a.details").alias("details"))


@query("a2_sql_level", "SELECT level, count(*) AS n FROM x_d_analysis GROUP BY level")
def levels(spark, sf):
    df = with_sql_analysis(_doc_sql(spark, sf), "sql", "a")
    return df.groupBy("a.level").agg(F.count("*").alias("n"))


@query("a3_dedup", "SELECT k AS event_id, details FROM x_a_warn")
def deduplicated(spark, sf):
    df = _command_sql(spark, sf).withColumn("n", normalise_sql(F.col("sql"))).withColumn("w", warn_details(query_findings("n")))
    return df.select("event_id", joined_some("w").alias("details"))


@query("a3_dedup_lines", """
SELECT doc_id, count(*) FILTER (w IS DISTINCT FROM before) AS kept FROM (
  SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))) GROUP BY doc_id""")
def deduplicated_words(spark, sf):
    words = dedup_consecutive(F.split("text", " "))
    return spread_table(spark, sf, "documents").select("doc_id", number(F.size(words)).alias("kept"))


_STACKED = next(r.pattern for r in R.SQL_RULES if r.name.startswith("Stacked query"))


@query("c11_stacked", f"""SELECT path, CAST(regexp_matches(norm, {quote(_STACKED)}) AS BIGINT) AS stacked
       FROM (SELECT k AS path, norm FROM x_d_norm)""")
def stacked(spark, sf):
    return _doc_sql(spark, sf).select("path", number(stacked_statement(F.col("sql"))).alias("stacked"))


# --- S5, S6: attached text ------------------------------------------------------------------------

def _command_sql(spark, sf):
    """SQL and cluster commands with the SQL the audit sees."""
    matched = match_action(command_log(spark, sf)).filter("guard in ('sql', 'cluster')")
    return attach_sql_files(with_sql_sources(matched), file_contents(spark, sf), "audit_source", "sql")


@query("s5_attach_sql_files", """SELECT m.event_id, a.kind, a.v AS value, md5(s.sql) AS digest FROM x_matched m
       JOIN x_auditsrc a USING (event_id) JOIN x_asql s ON s.k = m.event_id WHERE m.guard = 'sql'""")
def attached(spark, sf):
    df = _command_sql(spark, sf).filter("guard = 'sql'")
    return df.select("event_id", "audit_source.kind", "audit_source.value", F.md5("sql").alias("digest"))


@query("s6_staged_diffs", """SELECT m.event_id, coalesce(d.files_text, '') AS files, md5(d.diff) AS digest, d.error
       FROM x_matched m LEFT JOIN x_diffs d USING (event_id) WHERE m.guard = 'commit'""")
def staged(spark, sf):
    matched = match_action(command_log(spark, sf)).filter("guard = 'commit'")
    df = attach_diffs(matched, commit_diffs(spark, sf))
    return df.select("event_id", F.coalesce(F.array_join("files", ","), F.lit("")).alias("files"),
                     F.md5("diff").alias("digest"), "error")


# --- A4, A5, J3, C7, C8: table policy -------------------------------------------------------------

def _policy_sql(spark, sf):
    matched = match_action(command_log(spark, sf)).filter("guard = 'sql'")
    return attach_sql_files(with_sql_sources(matched), file_contents(spark, sf), "policy_source", "sql")


@query("a4_table_refs", "SELECT k AS event_id, string_agg(ref, ' | ' ORDER BY ref) AS refs FROM x_refs GROUP BY k")
def refs(spark, sf):
    df = _policy_sql(spark, sf).withColumn("refs", F.coalesce(table_refs(F.col("sql")), strings([])))
    return df.select("event_id", joined_some("refs").alias("refs"))


@query("a5_first_protected", 'SELECT k AS event_id, tname AS "table", mode FROM x_firsttab')
def protected(spark, sf):
    rules = policy(spark)
    df = _policy_sql(spark, sf).withColumn("t", first_protected(table_refs(F.col("sql")), rules))
    mode = F.when(F.col("t").isin([r.table for r in rules.tables if r.mode == "block"]), "block").otherwise("mask")
    return df.filter(F.col("t").isNotNull()).select("event_id", F.col("t").alias("table"), mode.alias("mode"))


@query("j3_table_policy", """
SELECT t.policy_id, r.k AS event_id, t.name AS "table", t.mode FROM x_refs r JOIN x_ptables t
  ON t.policy_id = 'p' || (r.k % 100 + 1) AND t.name = r.ref
UNION ALL SELECT t.policy_id, CAST(o_custkey AS BIGINT), t.name, t.mode FROM orders JOIN x_ptables t
  ON t.policy_id = 'p' || o_custkey AND t.name = 'cards_' || (o_custkey % 25)""")
def table_policies(spark, sf):
    tables = load_policies(policy_files(spark, sf)).tables
    queries = _policy_sql(spark, sf).select(
        F.concat(F.lit("p"), (F.col("event_id") % 100 + 1).cast("string")).alias("policy_id"),
        "event_id", F.explode(table_refs(F.col("sql"))).alias("ref"))
    per_customer = table(spark, sf, "orders").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("policy_id"),
        F.col("o_custkey").alias("event_id"),
        F.concat(F.lit("Cards_"), (F.col("o_custkey") % 25).cast("string")).alias("ref"))
    cols = ["policy_id", "event_id", "table", "mode"]
    return lookup_table_policy(queries, tables).select(cols).unionByName(
        lookup_table_policy(per_customer, tables).select(cols))


_TOUCHED = """SELECT o_orderkey AS id, 'p' || CAST(o_custkey AS STRING) AS policy_id, CASE o_orderkey % 6
  WHEN 0 THEN '/etc/' || split_part(o_orderpriority, '-', 2) || '/x' WHEN 1 THEN '/etc/BUILDING/a/b'
  WHEN 2 THEN '/home/u/.env.' || CAST(o_custkey AS STRING) WHEN 3 THEN '/srv/n' || CAST(o_custkey % 25 AS STRING) || '1.yaml'
  WHEN 4 THEN '/home/u' ELSE '/etc/MACHINERY' END AS path FROM {orders}"""


CTES.update({
    "x_touched": _TOUCHED.format(orders="orders"),
    "x_ownrules": """SELECT policy_id, line AS ord, tok[2] AS raw, tok[1][2:] AS mode,
          CASE WHEN tok[2] = '~' OR starts_with(tok[2], '~/') THEN '/home/u' || substr(tok[2], 2) ELSE tok[2] END AS e
        FROM x_plines JOIN x_pwin USING (policy_id, priority) WHERE tok[1] IN ('fblock', 'fmask')""",
    "x_ownhits": """SELECT t.id, t.policy_id, t.path, r.ord, r.raw, r.mode,
          row_number() OVER (PARTITION BY t.id ORDER BY r.ord) AS nth
        FROM x_touched t JOIN x_ownrules r ON r.policy_id = t.policy_id AND CASE
          WHEN ends_with(r.e, '/') THEN starts_with(t.path, r.e) OR t.path = rtrim(r.e, '/')
          ELSE regexp_full_match(t.path, replace(replace(replace(replace(replace(r.e, '.', '\\.'), '**', chr(1)),
               '*', '[^/]*'), '?', '.'), chr(1), '.*')) END""",
})


@query("j4_many_policies",
       "SELECT id, policy_id, path, CAST(ord AS BIGINT) AS ord, raw, mode FROM x_ownhits WHERE nth = 1")
def many_policies(spark, sf):
    """Every order's path against the rules of its customer's own policy."""
    touched = spark.sql(_TOUCHED, orders=table(spark, sf, "orders"))
    found = lookup_path_policy(touched, load_policies(policy_files(spark, sf), HOME).paths)
    return found.select("id", "policy_id", "path", number(F.col("ord")).alias("ord"), "raw", "mode")


CTES["x_rewritten"] = f"""
SELECT event_id, CASE WHEN fpos = 0 THEN sql ELSE {_head_sql('left(sql, fpos - 1)', 'tname', "tool = 'psql'")} || substr(sql, fpos) END AS rewritten
FROM (SELECT *, {_AT} AS fpos FROM (SELECT p.k AS event_id, p.tool, p.sql, t.tname, upper(p.sql) AS u
      FROM x_psql p JOIN x_firsttab t USING (k) WHERE t.mode = 'mask' AND NOT regexp_matches(p.sql, '(?i)\\bSELECT\\s+\\*')))"""


@query("c7_rewrite", "SELECT event_id, rewritten FROM x_rewritten")
def rewritten(spark, sf):
    done = audit(command_log(spark, sf), context(spark, sf), "sql").filter("masked")
    return done.select("event_id", F.col("masked_query").alias("rewritten"))


@query("c8_select_star", """SELECT k AS event_id, CAST(regexp_matches(sql, '(?i)\\bSELECT\\s+\\*') AS BIGINT) AS star
       FROM x_psql WHERE sql IS NOT NULL""")
def stars(spark, sf):
    df = _policy_sql(spark, sf).filter(F.col("sql").isNotNull())
    return df.select("event_id", number(selects_star(F.col("sql"))).alias("star"))


# --- G1, G2, G7, G8 -------------------------------------------------------------------------------

def _outcomes(spark, sf, outcome):
    ctx = context(spark, sf)
    matched = match_action(command_log(spark, sf)).filter("guard = 'sql'")
    df = with_sql_facts(with_sql_sources(matched), ctx.contents, ctx.policy)
    return flat_verdicts(df.withColumn("o", outcome(ctx.policy)).select(
        "event_id", "action", "o.verdict", "o.masked", "o.threat", F.col("o.query").alias("masked_query")),
        "masked_query")


def _with_query(verdicts: str) -> str:
    return (f"SELECT v.*, r.rewritten AS masked_query FROM (SELECT {VERDICT} FROM {verdicts}) v "
            "LEFT JOIN x_rewritten r USING (event_id)")


@query("g1_audit_sql", f"SELECT {VERDICT} FROM x_g1")
def sql_verdicts(spark, sf):
    ctx = Context(file_contents(spark, sf), commit_diffs(spark, sf))
    return flat_verdicts(audit(command_log(spark, sf), ctx, "sql"))


@query("g2_table_policy", _with_query("x_g2"))
def policy_verdicts(spark, sf):
    return _outcomes(spark, sf, lambda p: policy_outcome(F.col("hit"), F.col("tool"), p))


@query("g7_cluster_exec", f"SELECT {VERDICT} FROM x_cluster")
def cluster_verdicts(spark, sf):
    return flat_verdicts(audit(command_log(spark, sf), context(spark, sf), "cluster"))


@query("g8_chain", _with_query("x_sql"))
def chained(spark, sf):
    return flat_verdicts(audit(command_log(spark, sf), context(spark, sf), "sql"), "masked_query")


# --- S5, S6: several versions ---------------------------------------------------------------------

# Every file again: changed in the middle of the log (delivered twice), and once more later.
_VERSIONS = """
SELECT host, path, content, recorded_at FROM {contents}
UNION ALL SELECT host, path, 'DROP TABLE v2; ' || content, TIMESTAMP '2024-01-10 06:30:00' FROM {contents}
UNION ALL SELECT host, path, 'DROP TABLE v2; ' || content, TIMESTAMP '2024-01-10 06:30:00' FROM {contents}
UNION ALL SELECT host, path, 'SHOW TABLES', TIMESTAMP '2024-01-10 18:00:00' FROM {contents}
"""

CTES.update({
    "x_versions": "SELECT DISTINCT * FROM (" + _VERSIONS.format(contents="x_contents") + ")",
    "x_filecmd": """SELECT m.event_id, m.host, m.ts, s.kind, s.v FROM x_matched m
        JOIN x_auditsrc s ON s.event_id = m.event_id WHERE m.guard = 'sql'""",
    "x_vsql": """SELECT e.event_id AS k, CASE e.kind WHEN 'inline' THEN e.v ELSE c.content END AS sql
        FROM x_filecmd e ASOF LEFT JOIN x_versions c ON c.host = e.host AND c.path = e.v AND e.ts >= c.recorded_at""",
    **_audit_ctes("x_v", "x_vsql"),
})


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@query("s5_file_versions", """SELECT m.event_id, CASE a.level WHEN 'Dangerous' THEN 'Block' WHEN 'Suspicious' THEN 'Warn'
         ELSE 'Allow' END AS verdict, a.code FROM x_matched m LEFT JOIN x_v_analysis a ON a.k = m.event_id
       WHERE m.guard = 'sql'""")
def file_versions(spark, sf):
    """One verdict per command, by the newest version of its file at that time."""
    path = folder(spark, "contents")
    spark.sql(_VERSIONS, contents=file_contents(spark, sf)).select(_names(FILE_CONTENTS_SCHEMA)).write.parquet(path)
    versions = read_file_contents(spark, path)
    done = audit(command_log(spark, sf), Context(versions, commit_diffs(spark, sf)), "sql")
    return done.select("event_id", "verdict", "threat.code")


_DIFFS = """
SELECT event_id, recorded_at, files, diff, error FROM {diffs}
UNION ALL SELECT event_id, TIMESTAMP '2000-01-01 00:00:00', files, '+newer ' || diff, NULL FROM {diffs}
UNION ALL SELECT event_id, TIMESTAMP '2000-01-01 00:00:00', files, '+newer ' || diff, NULL FROM {diffs}
UNION ALL SELECT event_id, TIMESTAMP '2099-01-01 00:00:00', files, '+too late', NULL FROM {diffs}
"""


@query("s6_diff_versions", """SELECT m.event_id, md5('+newer ' || d.diff) AS digest FROM x_matched m
       LEFT JOIN x_diffs d USING (event_id) WHERE m.guard = 'commit'""")
def diff_versions(spark, sf):
    path = folder(spark, "diffs")
    spark.sql(_DIFFS, diffs=commit_diffs(spark, sf)).select(_names(COMMIT_DIFFS_SCHEMA)).write.parquet(path)
    versions = read_commit_diffs(spark, path)
    matched = match_action(command_log(spark, sf)).filter("guard = 'commit'")
    return attach_diffs(matched, versions).select("event_id", F.md5("diff").alias("digest"))
