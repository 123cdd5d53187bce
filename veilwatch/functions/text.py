"""Small text expressions shared by the jobs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()


def sql_literal(text: str) -> str:
    """The text as a Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_strings(values) -> str:
    items = ", ".join(sql_literal(v) for v in values)
    return f"array({items})" if items else "cast(array() as array<string>)"


def strings(values) -> Column:
    """A literal ``array<string>``, also when empty."""
    return F.expr(sql_strings(values))


def string_map(pairs) -> Column:
    """A literal ``map<string, string>``."""
    items = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in pairs)
    return F.expr(f"map({items})" if items else "cast(map() as map<string, string>)")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def ascii_upper(col: Column) -> Column:
    """Upper case for ASCII letters only, so positions in the result fit the original."""
    return F.translate(col, _LOWER, _UPPER)


def trim_ws(col: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def chomp(col: Column) -> Column:
    """The line without a final carriage return."""
    return F.when(col.endswith("\r"), F.left(col, F.length(col) - 1)).otherwise(col)


def text_lines(col: Column) -> Column:
    """Lines as an array: a final line break adds no line, ``\\r\\n`` counts as one break."""
    body = F.when(col.endswith("\n"), F.left(col, F.length(col) - 1)).otherwise(col)
    lines = F.transform(F.split(body, "\n"), lambda x: chomp(x))
    return F.when(col == "", strings([])).otherwise(lines)


def cut_sql(text: str, n: int) -> str:
    """SQL for a text cut to ``n`` characters and marked when longer."""
    return f"if(length({text}) > {n}, concat(left({text}, {n}), '...'), {text})"


def snippet(col: Column, n: int) -> Column:
    """The text without white space around it, cut to ``n`` characters and marked when longer."""
    kept = F.transform(F.array(trim_ws(col)), lambda t: F.when(
        F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t))
    return F.get(kept, 0)


def clip_bytes(col: Column, n: int) -> Column:
    """At most ``n`` bytes of UTF-8, never ending inside a character."""
    raw = col.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, k).cast("string"))
            for k in range(n, max(n - 4, -1), -1)]
    return F.when(F.octet_length(col) <= n, col).otherwise(F.coalesce(*cuts))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def marker_format(template: str, names) -> str:
    """A template with ``<name>`` markers as a format string over the names in their order."""
    out = template.replace("%", "%%")
    for i, name in enumerate(names, start=1):
        out = out.replace(f"<{name}>", f"%{i}$s")
    return out


def fill_format(fmt: Column, values: dict[str, Column]) -> Column:
    """Fill a column of format strings in one pass: markers inside a value stay as they are."""
    filled = F.call_function("format_string", fmt,
                             *[F.coalesce(v, F.lit("")) for v in values.values()])
    return F.when(fmt.isNotNull(), filled)


def replace_markers(template: str, values: dict[str, Column]) -> Column:
    """Fill ``<name>`` markers of a fixed template."""
    return fill_format(F.lit(marker_format(template, values)), values)


def quoted(col: Column) -> Column:
    """The text in double quotes with control characters escaped, other than the usual ones by number."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    numbered = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(
        c.rlike(r"[\x01-\x1f\x7f-\x{9f}]"),
        F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))).otherwise(c)), "")
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x01-\x1f\x7f-\x{9f}]"), numbered).otherwise(out), F.lit('"'))


def quoted_list(arr: Column) -> Column:
    """``["a", "b"]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: quoted(x)), ", "), F.lit("]"))


def java_quote(text: str) -> str:
    """A pattern that matches the text itself."""
    return re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", text)
