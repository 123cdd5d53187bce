"""Path patterns: ``*`` within a directory, ``**`` anything, ``?`` one character, a trailing ``/``
the directory and all below it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwatch.functions.text import java_quote


def expand_home(path: Column, home: Column) -> Column:
    """``~`` and ``~/…`` become the home directory; other paths stay."""
    tilde = (path == "~") | path.startswith("~/")
    return F.when(tilde & home.isNotNull(),
                  F.concat(home, F.substring(path, 2, F.length(path)))).otherwise(path)


def glob_regex(pattern: Column) -> Column:
    """The anchored regular expression of a path pattern."""
    body = F.regexp_replace(pattern, r"([\\.^$|()\[\]{}+])", r"\\$1")
    body = F.replace(body, F.lit("**"), F.lit("\u0001"))
    body = F.replace(body, F.lit("*"), F.lit("[^/]*"))
    body = F.replace(body, F.lit("?"), F.lit("."))
    body = F.replace(body, F.lit("\u0001"), F.lit(".*"))
    below = F.concat(F.lit("(?s)^(?:"), _quote(F.regexp_replace(pattern, r"/+\z", "")),
                     F.lit("|"), _quote(pattern), F.lit(r".*)\z"))
    return F.when(pattern.endswith("/"), below).otherwise(
        F.concat(F.lit("(?s)^"), body, F.lit(r"\z")))


def _quote(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|()\[\]{}*+?])", r"\\$1")


def glob_test(path: Column, pattern: str) -> Column:
    """Whether the path fits one known pattern; plain patterns need no regular expression."""
    if pattern.endswith("/"):
        return path.startswith(pattern) | (path == pattern.rstrip("/"))
    if "*" not in pattern and "?" not in pattern:
        return path == pattern
    body = java_quote(pattern.replace("**", "\u0001")).replace(r"\*", "[^/]*").replace(r"\?", ".")
    return path.rlike("(?s)^" + body.replace("\u0001", ".*") + r"\z")


def resolve_path(token: Column, cwd: Column, home: Column) -> Column:
    """Absolute paths stay, ``~/`` goes below home, others below the working directory if known."""
    below_home = F.substring(token, 3, F.length(token))
    joined = F.concat(F.regexp_replace(cwd, r"/\z", ""), F.lit("/"), token)
    return (F.when(token.startswith("/"), token)
            .when(token.startswith("~/") & home.isNotNull(),
                  F.when(below_home.startswith("/"), below_home)
                  .otherwise(F.concat(F.regexp_replace(home, r"/\z", ""), F.lit("/"), below_home)))
            .when(cwd.isNotNull(), joined)
            .otherwise(token))
