"""Policy files: a Spark parser for many files, and the compiled form one job works with."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.globs import expand_home, glob_regex
from veilwatch.functions.text import ascii_lower, text_lines, trim_ws
from veilwatch.rules.mask_rules import DIRECTIVES, PARTIAL_MAX


class ColumnRule(NamedTuple):
    column: str
    kind: str
    n: int | None


class TableRule(NamedTuple):
    table: str
    mode: str
    columns: list[ColumnRule]


class PathRule(NamedTuple):
    ord: int
    raw: str
    expanded: str
    mode: str


class Policy(NamedTuple):
    """One policy as compiled into column expressions: as many entries as its file has lines."""

    tables: list[TableRule]
    paths: list[PathRule]

    def table(self, name: str) -> TableRule | None:
        return next((t for t in self.tables if t.table == name.lower()), None)

    @property
    def empty(self) -> bool:
        return not self.tables and not self.paths


class ParsedPolicies(NamedTuple):
    loaded: DataFrame
    tables: DataFrame
    columns: DataFrame
    paths: DataFrame
    errors: DataFrame


def _kind_of(spec: Column) -> Column:
    """Mask kind of a column spec, null when unknown."""
    text = F.substring(spec, F.instr(spec, ":") + 1, F.length(spec))
    n = _partial_length(text)
    return (F.when(text.isin("redact", "email", "phone"), text)
            .when(n.isNotNull() & (n <= PARTIAL_MAX), F.lit("partial")))


def _partial_length(text: Column) -> Column:
    digits = F.regexp_extract(text, r"^partial:\+?0*([0-9]{1,9})\z", 1)
    return digits.try_cast("int")


def _reason(tokens: Column) -> Column:
    """Why a policy line is not acceptable; null when it is."""
    word = F.try_element_at(tokens, F.lit(1))
    specs = F.slice(tokens, F.lit(3), F.greatest(F.size(tokens) - 2, F.lit(0)))
    bad = F.filter(specs, lambda s: (F.instr(s, ":") == 0) | _kind_of(s).isNull())
    first = F.try_element_at(bad, F.lit(1))
    return (F.when(F.size(tokens) < 2, "incomplete")
            .when(~word.isin(DIRECTIVES), "unknown directive")
            .when(word.isin("block", "mask") & (F.size(bad) > 0),
                  F.when(F.instr(first, ":") == 0, "bad column spec")
                  .otherwise("unknown mask kind")))


def parse_policy_lines(files: DataFrame) -> DataFrame:
    """One row per file with its rule lines: ``array<struct<line, tokens, reason>>``.

    Parsing stays inside the row; blank and comment lines are gone.
    """
    lines = F.transform(text_lines(F.col("content")), lambda x, i: F.struct(
        (i + 1).alias("line"), trim_ws(x).alias("text")))
    kept = F.filter(lines, lambda x: (x["text"] != "") & ~x["text"].startswith("#"))
    tokens = F.transform(kept, lambda x: F.struct(
        x["line"].alias("line"), F.split(x["text"], r"(?U)\s+").alias("tokens")))
    rules = F.transform(tokens, lambda x: F.struct(
        x["line"].alias("line"), x["tokens"].alias("tokens"), _reason(x["tokens"]).alias("reason")))
    return files.select("policy_id", "priority", rules.alias("rules"))


def load_policies(files: DataFrame, home: str | None = None) -> ParsedPolicies:
    """Parse policy files; per policy the file of lowest priority that parses wins.

    One bad line rejects its whole file.  A table named twice keeps its last rule; path rules keep
    their order.  Errors hold the first bad line of every rejected file.
    """
    parsed = parse_policy_lines(files)
    first_bad = F.try_element_at(
        F.filter("rules", lambda r: r["reason"].isNotNull()), F.lit(1))
    parsed = parsed.withColumn("bad", first_bad)
    errors = (parsed.filter(F.col("bad").isNotNull())
              .select("policy_id", "priority", F.col("bad.line").alias("line"),
                      F.col("bad.reason").alias("reason")))
    winners = (parsed.filter(F.col("bad").isNull())
               .groupBy("policy_id").agg(F.min_by("rules", "priority").alias("rules")))
    rules = (winners.select("policy_id", F.explode("rules").alias("r"))
             .select("policy_id", F.col("r.line").alias("line"),
                     F.element_at("r.tokens", 1).alias("word"),
                     F.element_at("r.tokens", 2).alias("target"),
                     F.slice("r.tokens", F.lit(3), F.size("r.tokens")).alias("specs")))

    last = (rules.filter(F.col("word").isin("block", "mask"))
            .groupBy("policy_id", ascii_lower(F.col("target")).alias("table"))
            .agg(F.max_by(F.struct("word", "specs", "line"), "line").alias("r")))
    tables = last.select("policy_id", "table", F.col("r.word").alias("mode"),
                         F.col("r.line").alias("ord"))
    spec = F.col("spec")
    kind_text = F.substring(spec, F.instr(spec, ":") + 1, F.length(spec))
    columns = (last.select("policy_id", "table", F.posexplode("r.specs").alias("pos", "spec"))
               .select("policy_id", "table",
                       ascii_lower(F.substring_index(spec, ":", 1)).alias("column"),
                       _kind_of(spec).alias("kind"), _partial_length(kind_text).alias("n"),
                       (F.col("pos") + 1).alias("col_ord")))
    expanded = expand_home(F.col("target"), F.lit(home).cast("string"))
    paths = (rules.filter(F.col("word").isin("fblock", "fmask"))
             .select("policy_id", F.col("line").alias("ord"), F.col("target").alias("raw"),
                     expanded.alias("expanded"), glob_regex(expanded).alias("regex"),
                     F.substring("word", 2, 10).alias("mode")))
    return ParsedPolicies(winners, tables, columns, paths, errors)


def policy_summary(parsed: ParsedPolicies) -> DataFrame:
    """Number of tables and of path rules per loaded policy, counted inside the row."""
    def lines(*words):
        return F.filter("rules", lambda r: F.element_at(r["tokens"], 1).isin(*words))

    names = F.transform(lines("block", "mask"), lambda r: ascii_lower(F.element_at(r["tokens"], 2)))
    return parsed.loaded.select(
        "policy_id", F.size(F.array_distinct(names)).cast("bigint").alias("n_tables"),
        F.size(lines("fblock", "fmask")).cast("bigint").alias("n_paths"))


def compile_policy(parsed: ParsedPolicies, policy_id: str) -> Policy:
    """Fetch one policy's rules, as many as its file has lines, to build expressions from."""
    mine = F.col("policy_id") == policy_id
    null = F.lit(None)
    rows = (
        parsed.tables.filter(mine).select(
            F.lit("table").alias("what"), F.col("ord"), F.col("table").alias("name"),
            F.col("mode").alias("kind"), null.cast("int").alias("n"),
            null.cast("string").alias("expanded"))
        .unionByName(parsed.columns.filter(mine).select(
            F.lit("column").alias("what"), F.col("col_ord").alias("ord"),
            F.concat_ws("\n", "table", "column").alias("name"), "kind", "n",
            null.cast("string").alias("expanded")))
        .unionByName(parsed.paths.filter(mine).select(
            F.lit("path").alias("what"), "ord", F.col("raw").alias("name"),
            F.col("mode").alias("kind"), null.cast("int").alias("n"), "expanded"))
    ).collect()
    columns: dict[str, list] = {}
    for r in sorted((r for r in rows if r["what"] == "column"), key=lambda r: r["ord"]):
        table, column = r["name"].split("\n")
        columns.setdefault(table, []).append(ColumnRule(column, r["kind"], r["n"]))
    tables = sorted(TableRule(r["name"], r["kind"], columns.get(r["name"], []))
                    for r in rows if r["what"] == "table")
    paths = sorted(PathRule(r["ord"], r["name"], r["expanded"], r["kind"])
                   for r in rows if r["what"] == "path")
    return Policy(tables, paths)


def policy_from_text(spark, content: str, home: str | None = None) -> Policy:
    """Parse and compile one policy text; an unacceptable text raises."""
    files = spark.createDataFrame([("policy", 1, content)],
                                  "policy_id string, priority int, content string")
    parsed = load_policies(files, home)
    bad = parsed.errors.first()
    if bad is not None:
        raise ValueError(f"policy line {bad['line']}: {bad['reason']}")
    return compile_policy(parsed, "policy")
