"""Column masks, query rewriting, text masking and secret detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.text import ascii_upper, java_quote
from veilwatch.rules import mask_rules as M
from veilwatch.rules.text_rules import TEXT_RULES, java_pattern

HIT_TYPE = "struct<kind:string,snippet:string,digest:string>"
SNIPPET_CHARS = 12  # of a secret at most, enough to recognise its kind
SNIPPET_PART = 3  # and never more than a third of it


def mask_redact(col: Column) -> Column:
    return F.lit(M.REDACTED)


def mask_email(col: Column) -> Column:
    return F.concat(F.left(col.cast("string"), F.lit(1)), F.lit(M.EMAIL_TAIL))


def mask_phone(col: Column) -> Column:
    return F.concat(F.lit(M.PHONE_HEAD), F.right(col.cast("string"), F.lit(M.PHONE_DIGITS)))


def mask_partial(col: Column, n: int) -> Column:
    if not 0 <= n <= M.PARTIAL_MAX:
        raise ValueError(f"partial length {n} is outside 0..{M.PARTIAL_MAX}")
    return F.concat(F.left(col.cast("string"), F.lit(n)), F.lit(M.PARTIAL_TAIL))


def mask_column(col: Column, kind: str, n: int | None = None) -> Column:
    if kind == "partial":
        return mask_partial(col, n)
    return {"redact": mask_redact, "email": mask_email, "phone": mask_phone}[kind](col)


def mask_table(df: DataFrame, table: str, policy) -> DataFrame:
    """Mask a table's columns by policy; raise when the policy blocks the table.

    Other columns are untouched, so pruning and pushdown work as before.
    """
    rule = policy.table(table)
    if rule is None:
        return df
    if rule.mode == "block":
        raise PermissionError(f"table {table!r} is blocked by policy")
    names = {c.lower(): c for c in df.columns}
    masked = {names[c.column]: mask_column(F.col(names[c.column]), c.kind, c.n)
              for c in rule.columns if c.column in names}
    return df.withColumns(masked) if masked else df


def mask_sql_text(column: str, kind: str, n: int | None, dialect: str) -> str:
    """The masking expression as SQL text, aliased to the column's name."""
    return M.SQL_TEXT[(kind, dialect)].format(c=column, n=n)


def split_at_from(sql: Column) -> Column:
    """1-based position of the first FROM with a blank before it, else with a line break, else with
    a tab; 0 when there is none."""
    upper = ascii_upper(sql)
    found = [F.nullif(F.instr(upper, lead + "FROM "), F.lit(0)) for lead in (" ", "\n", "\t")]
    return F.coalesce(*found, F.lit(0))


def rewrite_select(sql: Column, columns, dialect: str) -> Column:
    """Replace policy columns, as whole words, in the part before the first FROM."""
    at = split_at_from(sql)
    head = F.left(sql, at - 1)
    for c in columns:
        text = mask_sql_text(c.column, c.kind, c.n, dialect).replace("\\", "\\\\").replace("$", "\\$")
        head = F.regexp_replace(head, rf"(?Ui)\b{java_quote(c.column)}\b", text)
    rest = F.substring(sql, at, F.length(sql))
    return F.when(at == 0, sql).otherwise(F.concat(head, rest))


def mask_text(text: Column, rules=TEXT_RULES) -> Column:
    """Replace secrets and personal data by labels, rule by rule in order.

    Ten of the twelve rules need a fixed piece of text, one needs one of six words.  A label
    never takes part in a match of these, so rows without them skip those rules.
    """
    def apply(col: Column, some) -> Column:
        for rule in some:
            col = F.regexp_replace(col, java_pattern(rule), rule.label)
        return col

    special = F.lit(False)
    for rule in rules:
        if rule.literal:
            special = special | F.contains(text, F.lit(rule.literal))
    plain = [r for r in rules if not r.literal]
    no_word = [r for r in plain if not r.words]
    return (F.when(special, apply(text, rules))
            .when(_holds_word(text), apply(text, plain)).otherwise(apply(text, no_word)))


def _holds_word(text: Column) -> Column:
    """Whether the text holds one of the words a case-insensitive rule needs.

    Lower, then upper: letters are folded the way the pattern compares them.
    """
    folded = F.upper(F.lower(text))
    out = F.lit(False)
    for word in [w for r in TEXT_RULES for w in r.words]:
        out = out | F.contains(folded, F.lit(word))
    return out


def secret_hits(line: Column) -> Column:
    """Secrets of one line as an array of (kind, snippet, digest), in rule order, then by position.

    The digest tells secrets apart that begin alike; the snippet never shows more than a part.
    """
    def hits(rule) -> Column:
        found = F.regexp_extract_all(line, F.lit(java_pattern(rule)), 0)
        out = F.transform(found, lambda m: F.struct(
            F.lit(rule.kind).alias("kind"),
            F.concat(F.left(m, F.least(F.lit(SNIPPET_CHARS), F.floor(F.length(m) / SNIPPET_PART).cast("int"))),
                     F.lit("...")).alias("snippet"),
            F.sha2(m, 256).alias("digest")))
        empty = F.array().cast(f"array<{HIT_TYPE}>")
        if rule.literal:
            return F.when(F.contains(line, F.lit(rule.literal)), out).otherwise(empty)
        if rule.words:
            return F.when(_holds_word(line), out).otherwise(empty)
        return out

    return F.flatten(F.array(*[hits(r) for r in TEXT_RULES]))
