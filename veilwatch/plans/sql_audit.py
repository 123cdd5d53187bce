"""SQL guards: rule audit, table policy, and SQL run inside a cluster exec.

Facts about SQL text (findings, policy hit) are worked out where the text lives: on the command's
row for inline SQL, once per file for SQL files.  Only the small facts are joined to the commands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.argv import after_separator, extract_sql, names_file, pod_name
from veilwatch.functions.masking import rewrite_select
from veilwatch.functions.sqltext import selects_star, table_refs, with_sql_analysis
from veilwatch.functions.text import ascii_lower, basename, replace_markers, string_map, strings
from veilwatch.functions.verdicts import allow, block, chain, masked, threat, warn
from veilwatch.operators.joins import SALTS, computed_once
from veilwatch.rules.sql_rules import SQL_TOOLS
from veilwatch.rules.threat_texts import UNSEEN_SQL
from veilwatch.session import cut_lineage
from veilwatch.sources.contents import FILE, newest_versions, version_texts
from veilwatch.sources.policy import Policy

_LABELS = {name: spec.label for name, spec in SQL_TOOLS.items()}


def tool_label(tool: Column) -> Column:
    return F.try_element_at(string_map(_LABELS.items()), tool)


# --- facts about SQL text -------------------------------------------------------------------------

def first_protected(refs: Column, policy: Policy) -> Column:
    """The protected table of a query: blocked ones before masked ones, then by name."""
    out = F.lit(None).cast("string")
    for mode in ("mask", "block"):
        names = sorted(t.table for t in policy.tables if t.mode == mode)
        hits = F.array_intersect(refs, strings(names))
        out = F.coalesce(F.array_min(hits), out)
    return out


def lookup_table_policy(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """The table rules of each row's own policy (``policy_id``) that name its table (``ref``).

    Names are compared in lower case; Spark broadcasts the rules where their size allows.
    """
    return refs.withColumn("table", ascii_lower(F.col("ref"))).join(tables, ["policy_id", "table"])


def with_policy_hit(df: DataFrame, sql: str, policy: Policy, out: str) -> DataFrame:
    """Add ``out``: struct of protected table, its mode, whether all columns are selected, and the
    query text where it is to be rewritten; null when no protected table is touched."""
    refs, table = F.col(f"_{out}_refs"), F.col(f"_{out}_table")
    mode = F.try_element_at(string_map((t.table, t.mode) for t in policy.tables), table)
    star = F.coalesce(selects_star(F.col(sql)), F.lit(False))
    hit = F.struct(table.alias("table"), mode.alias("mode"), star.alias("star"),
                   F.when((mode == "mask") & ~star, F.col(sql)).alias("text"))
    df = (df.withColumn(f"_{out}_refs", table_refs(F.col(sql)))
          .withColumn(f"_{out}_table", first_protected(refs, policy)))
    return (computed_once(df, out, F.when(table.isNotNull(), hit))
            .drop(f"_{out}_refs", f"_{out}_table"))


def masked_query(text: Column, table: Column, tool: Column, policy: Policy) -> Column:
    """The rewritten query: one expression per masked table and dialect, chosen by the row."""
    out = F.when(F.lit(False), F.lit(""))
    dialects = {}
    for name, spec in SQL_TOOLS.items():
        dialects.setdefault(spec.dialect, []).append(name)
    for rule in policy.tables:
        if rule.mode == "mask":
            for dialect, tools in dialects.items():
                out = out.when((table == rule.table) & tool.isin(tools),
                               rewrite_select(text, rule.columns, dialect))
    return out


# --- attaching facts ------------------------------------------------------------------------------

def with_sql_sources(cmds: DataFrame) -> DataFrame:
    """Add ``audit_source`` and ``policy_source`` of SQL commands, and for cluster commands ``pod``,
    ``inner_tool`` and the audit source of their inner command."""
    sub, inner = F.col("_sub"), F.col("_inner")
    cluster, sql = F.col("guard") == "cluster", F.col("guard") == "sql"
    # the exec token must come after the program name
    runs = F.expr("array_contains(slice(argv, 2, size(argv)), 'exec')")
    return (cmds.withColumn("_sub", F.when(cluster & runs, after_separator()))
            .withColumn("_inner", basename(F.try_element_at(sub, F.lit(1))))
            .withColumn("inner_tool", F.when(inner.isin(list(SQL_TOOLS)), inner))
            .withColumn("pod", F.when(F.col("inner_tool").isNotNull(), pod_name()))
            .withColumn("audit_source", F.when(sql, extract_sql("argv", "tool", "audit"))
                        .when(cluster, extract_sql("_sub", "inner_tool", "audit")))
            .withColumn("policy_source", F.when(sql, extract_sql("argv", "tool", "policy")))
            .drop("_sub", "_inner"))


def _value(source: str, kind: str) -> Column:
    return F.when(F.col(source)["kind"] == kind, F.col(source)["value"])


def _small_facts() -> list[Column]:
    """What verdicts need of the facts; a query's text only where it is to be rewritten."""
    return [F.col("analysis").dropFields("category", "all_details").alias("analysis"), F.col("hit")]


def file_facts(chosen: DataFrame, contents: DataFrame, policy: Policy) -> DataFrame:
    """Facts of every file version some command saw, once each: ``host, path, recorded_at, analysis, hit``."""
    files = with_sql_analysis(version_texts(chosen, contents), "content", "analysis")
    files = with_policy_hit(files, "content", policy, "hit")
    return files.select(*FILE, "recorded_at", *_small_facts())


def with_inline_facts(cmds: DataFrame, policy: Policy) -> DataFrame:
    """Add ``analysis`` (rule audit) and ``hit`` (table policy) of SQL given on the command line."""
    df = (cmds.withColumn("_sql", _value("audit_source", "inline"))
          .withColumn("_psql", _value("policy_source", "inline")))
    df = with_sql_analysis(df, "_sql", "analysis")
    df = with_policy_hit(df, "_psql", policy, "hit").drop("_sql", "_psql")
    return df.withColumns(dict(zip(("analysis", "hit"), _small_facts())))


def with_file_facts(cmds: DataFrame, contents: DataFrame, policy: Policy,
                    salts: int = SALTS) -> DataFrame:
    """Like ``with_inline_facts``, and the facts of the SQL files as the commands saw them.

    Facts are worked out once per file version and brought to the commands by ``event_id``, so a file
    that everybody runs makes no hot key there.
    """
    # a command may name a file for one of the two and hold SQL for the other
    inline = cmds.filter((F.col("audit_source")["kind"] == "inline") | (F.col("policy_source")["kind"] == "inline"))
    inline = cut_lineage(with_inline_facts(inline.select("event_id", "audit_source", "policy_source")
                                           .dropDuplicates(["event_id"]), policy)
                         .select("event_id", "analysis", "hit"))
    df = (cmds.join(inline, "event_id", "left")
          .withColumn("_apath", _value("audit_source", "file"))
          .withColumn("_ppath", _value("policy_source", "file")))
    paths = F.array_distinct(F.array_compact(F.array(_value("audit_source", "file"),
                                                     _value("policy_source", "file"))))
    # written once: the versions and their facts are each read twice below
    wanted = cut_lineage(cmds.select("event_id", "host", F.explode(paths).alias("path"), "ts").distinct())
    chosen = cut_lineage(newest_versions(wanted, contents, salts))
    facts = cut_lineage(file_facts(chosen, contents, policy))
    known = chosen.join(facts, [*FILE, "recorded_at"])
    by_audit = known.select("event_id", F.col("path").alias("_apath"), F.col("analysis").alias("_fa"))
    by_policy = known.select("event_id", F.col("path").alias("_ppath"), F.col("hit").alias("_fh"))
    df = df.join(by_audit, ["event_id", "_apath"], "left").join(by_policy, ["event_id", "_ppath"], "left")
    return (df.withColumns({"analysis": F.coalesce("analysis", "_fa"),
                            "hit": F.coalesce("hit", "_fh")})
            .drop("_apath", "_ppath", "_fa", "_fh"))


def with_sql_facts(cmds: DataFrame, contents: DataFrame, policy: Policy, salts: int = SALTS) -> DataFrame:
    """Facts of all commands; only those that may name a file are joined."""
    # the split tests the stored tokens: a filter on the extracted paths would work them out again
    return (with_file_facts(cmds.filter(names_file()), contents, policy, salts)
            .unionByName(with_inline_facts(cmds.filter(~names_file()), policy)))


# --- outcomes -------------------------------------------------------------------------------------

def sql_outcome(analysis: Column, label: Column) -> Column:
    """No readable SQL or clean: allow; suspicious: warn; dangerous: block with its category."""
    what = threat(analysis["code"], label, None, analysis["details"])
    return (F.when(analysis["level"] == "Suspicious", warn(what))
            .when(analysis["level"] == "Dangerous", block(what)).otherwise(allow()))


def _columns_of(table: Column, policy: Policy) -> Column:
    out = F.when(F.lit(False), strings([]))
    for rule in policy.tables:
        out = out.when(table == rule.table, strings([c.column for c in rule.columns]))
    return F.coalesce(out, strings([]))


def policy_outcome(hit: Column, tool: Column, policy: Policy) -> Column:
    """A masked table can be read column by column, by the rewritten query; a blocked one, or all
    columns, cannot."""
    columns, label = _columns_of(hit["table"], policy), tool_label(tool)
    query = masked_query(hit["text"], hit["table"], tool, policy)
    return (F.when(hit.isNull(), allow())
            .when((hit["mode"] == "mask") & ~hit["star"],
                  masked(threat("DATA_POLICY_MASKED", label, hit["table"], columns), query))
            .otherwise(block(threat("DATA_POLICY_BLOCK", label, hit["table"], columns))))


def with_sql_outcome(df: DataFrame, policy: Policy, out: str = "outcome",
                     gate: Column | None = None) -> DataFrame:
    """The table policy first, the rule audit only where it allows."""
    gate = F.lit(True) if gate is None else gate
    label = tool_label(F.col("tool"))
    first = policy_outcome(F.col("hit"), F.col("tool"), policy)
    second = sql_outcome(F.col("analysis"), label)
    both = second if policy.empty else chain(F.col("_first"), second)
    if not policy.empty:
        df = df.withColumn("_first", F.when(gate, first))
    return df.withColumn(out, F.when(gate, both)).drop("_first")


def with_cluster_outcome(df: DataFrame, out: str = "outcome", gate: Column | None = None) -> DataFrame:
    """Inside a cluster exec, suspicious SQL and SQL that cannot be seen are blocked as well."""
    gate = F.lit(True) if gate is None else gate
    tool, analysis = F.col("inner_tool"), F.col("analysis")
    unseen = replace_markers(UNSEEN_SQL, {"tool": tool})
    code = "KUBECTL_SQL_THREAT"
    outcome = (
        F.when(tool.isNull(), allow())
        .when(analysis.isNull(), block(threat(code, tool, F.col("pod"), F.array(unseen),
                                              "SQL_DESTRUCTIVE")))
        .when(analysis["level"] == "Clean", allow())
        .otherwise(block(threat(code, tool, F.col("pod"), analysis["details"], analysis["code"]))))
    return df.withColumn(out, F.when(gate, outcome))
