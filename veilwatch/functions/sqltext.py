"""SQL text expressions: normalising, statements, findings, referenced tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.text import ascii_lower, cut_sql, sql_literal, strings
from veilwatch.operators.joins import computed_once
from veilwatch.rules import sql_rules as R

FINDING_TYPE = "struct<block:boolean,rank:int,category:string,detail:string>"
_RANK = {name: rank for rank, (name, _) in enumerate(R.CATEGORY_PRIORITY, start=1)}


def _java(pattern: str) -> str:
    return "(?U)" + pattern


def normalise_sql(sql: Column) -> Column:
    """Comments become a blank, white space runs one blank, ends trimmed.

    Block comments are only looked for up to the last ``*/``: behind it none can end, and a text
    full of unclosed comment openers would otherwise be scanned to its end once per opener.
    """
    tail = F.substring_index(sql, "*/", -1)
    head = F.left(sql, F.length(sql) - F.length(tail))
    text = F.concat(F.regexp_replace(head, r"/\*[\s\S]*?\*/", " "), tail)
    text = F.regexp_replace(text, r"--[^\n]*", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def statements(normalised: Column) -> Column:
    """Trimmed non-empty pieces between semicolons."""
    return F.filter(F.transform(F.split(normalised, ";"), lambda s: F.trim(s)), lambda s: s != "")


def _statements_sql(normalised: str) -> str:
    """``statements`` of a column name as SQL text."""
    return f"filter(transform(split({normalised}, ';'), s -> trim(s)), s -> s <> '')"


def _finding(test: str, block: bool, category: str | None, name: str) -> str:
    rank = _RANK.get(category) or "null"
    label = "null" if category is None else sql_literal(category)
    return (f"case when {test} then named_struct('block', {str(block).lower()}, "
            f"'rank', cast({rank} as int), 'category', cast({label} as string), "
            f"'detail', concat({sql_literal(name + ' -- `')}, p.snip, '`')) end")


def _statement_findings() -> str:
    """Findings of one statement ``p(stmt, up, snip)`` in rule order, as SQL text.

    ``p.up`` is folded to upper case the way case-insensitive patterns compare letters, so a rule
    whose fixed text is missing there cannot match and its pattern is not run.
    """
    def like(pattern: str) -> str:
        return f"rlike(p.stmt, {sql_literal(_java(pattern))})"

    def holds(texts: list[str]) -> str:
        return "(" + " or ".join(f"contains(p.up, {sql_literal(t)})" for t in texts) + ")"

    found = [_finding(f"{holds(R.NEEDS[r.ord])} and {like(r.pattern)}", r.block, r.category, r.name)
             for r in R.SQL_RULES]
    for word, pattern, name in (("DELETE", R.DELETE_PATTERN, R.DELETE_WITHOUT_WHERE),
                                ("UPDATE", R.UPDATE_PATTERN, R.UPDATE_WITHOUT_WHERE)):
        test = f"{holds([word])} and {like(pattern)} and not {like(R.WHERE_PATTERN)}"
        found.append(_finding(test, True, "Destructive", name))
    return f"array_compact(array({', '.join(found)}))"


def query_findings(normalised: str) -> Column:
    """Findings of all statements of a normalised query (a column name), in statement and rule
    order, as an array of ``FINDING_TYPE``."""
    parts = (f"transform({_statements_sql(normalised)}, s -> named_struct('stmt', s, "
             f"'up', upper(lower(s)), 'snip', {cut_sql('s', R.SNIPPET_CHARS)}))")
    return F.expr(f"flatten(transform({parts}, p -> {_statement_findings()}))")


def dedup_consecutive(arr: Column) -> Column:
    """Drop elements equal to the one before.

    Every element is paired with its predecessor first: a lambda that looked it up in ``arr`` would
    work ``arr`` out once per element when it is an expression.
    """
    before = F.concat(F.array(F.lit(None).cast("string")), arr)
    pairs = F.zip_with(arr, F.slice(before, F.lit(1), F.size(arr)),
                       lambda x, b: F.struct(x.alias("x"), b.alias("b")))
    return F.transform(F.filter(pairs, lambda p: ~p["x"].eqNullSafe(p["b"])), lambda p: p["x"])


def block_findings(findings: Column) -> Column:
    return F.filter(findings, lambda f: f["block"])


def warn_details(findings: Column) -> Column:
    return dedup_consecutive(
        F.transform(F.filter(findings, lambda f: ~f["block"]), lambda f: f["detail"]))


def top_rank(blocks: Column) -> Column:
    return F.array_min(F.transform(blocks, lambda f: f["rank"]))


def category_of(rank: Column) -> Column:
    return F.get(strings([c for c, _ in R.CATEGORY_PRIORITY]), rank - 1)


def code_of(rank: Column) -> Column:
    return F.get(strings([code for _, code in R.CATEGORY_PRIORITY]), rank - 1)


def with_sql_analysis(df: DataFrame, sql: str, out: str) -> DataFrame:
    """Add ``out``: struct of level, category, code, details and all finding details.

    Level is Clean, Suspicious or Dangerous.  Details are those of the winning category only;
    ``all_details`` keeps every finding.  Null SQL gives a null struct.  Map-only.
    """
    q, f, b, w, r = (f"_{out}_{x}" for x in ("norm", "findings", "blocks", "warns", "rank"))
    known = F.col(sql).isNotNull()
    df = (df
          .withColumn(q, normalise_sql(F.col(sql)))
          .withColumn(f, query_findings(q))
          .withColumn(b, block_findings(F.col(f)))
          .withColumn(w, warn_details(F.col(f)))
          .withColumn(r, top_rank(F.col(b))))
    dangerous = F.size(b) > 0
    details = F.when(dangerous, F.transform(
        F.filter(F.col(b), lambda x: x["rank"] == F.col(r)), lambda x: x["detail"])
    ).otherwise(F.col(w))
    analysis = F.struct(
        F.when(dangerous, "Dangerous").when(F.size(w) > 0, "Suspicious")
        .otherwise("Clean").alias("level"),
        category_of(F.col(r)).alias("category"),
        F.when(dangerous, code_of(F.col(r))).when(F.size(w) > 0, F.lit("SQL_SUSPICIOUS"))
        .alias("code"),
        details.alias("details"),
        F.transform(F.col(f), lambda x: x["detail"]).alias("all_details"))
    return computed_once(df, out, F.when(known, analysis)).drop(q, f, b, w, r)


def stacked_statement(sql: Column) -> Column:
    """Opt-in test of the unsplit text: a changing statement after a semicolon.

    The audit splits on semicolons first, so its own rule of this name never fires.
    """
    rule = next(r for r in R.SQL_RULES if r.name.startswith("Stacked query"))
    return normalise_sql(sql).rlike(_java(rule.pattern))


def table_refs(sql: Column) -> Column:
    """Distinct lower-cased names after FROM, JOIN, UPDATE and INTO, sorted."""
    found = [F.regexp_extract_all(sql, F.lit(_java(p)), 1) for p in R.TABLE_REF_PATTERNS]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found), ascii_lower)))


def selects_star(sql: Column) -> Column:
    return sql.rlike(_java(R.SELECT_STAR_PATTERN))
