"""Unified diffs: lines attributed to file and new-file line number, secrets on added lines.

Numbering needs no window.  A diff is cut at file headers, each piece at valid hunk headers; inside
such a segment every line that is not a removal counts one, so a line's number is the segment's base
plus its position among the lines that are not removals.  All of it happens inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.masking import secret_hits
from veilwatch.functions.text import chomp, strings

# Line starts that carry meaning.
FILE_HEADER = "+++ b/"
HUNK_START = "@@"

# Digits of a number below 2**32, not followed by another digit.
_U32 = (r"0*(?:[0-9]{1,9}|[1-3][0-9]{9}|4[01][0-9]{8}|42[0-8][0-9]{7}|429[0-3][0-9]{6}"
        r"|4294[0-8][0-9]{5}|42949[0-5][0-9]{4}|429496[0-6][0-9]{3}|4294967[01][0-9]{2}"
        r"|42949672[0-8][0-9]|429496729[0-5])(?![0-9])")
_HUNK = rf"@@[^+\n]*\+({_U32})"
_CUT_FILES = r"\n(?=\+\+\+ b/)"
_CUT_HUNKS = rf"\n(?={_HUNK})"

HIT_TYPE = "struct<file:string,line:bigint,kind:string,snippet:string>"
LINE_TYPE = "struct<line:bigint,added:boolean,text:string>"


def hunk_start(line: Column) -> Column:
    """New-file start of a hunk header; null when it has none that fits 32 bits."""
    digits = F.regexp_extract(line, "^" + _HUNK, 1)
    return F.when(digits != "", digits.cast("bigint"))


def _file_of(block: Column) -> Column:
    first = chomp(F.substring_index(block, "\n", 1))
    return F.when(block.startswith(FILE_HEADER),
                  F.substring(first, len(FILE_HEADER) + 1, F.length(first))).otherwise(F.lit(""))


def _base(segment: Column) -> Column:
    """The number before the first counted line of a segment."""
    zero = F.lit(0).cast("bigint")
    return F.greatest(F.coalesce(hunk_start(segment), zero) - 1, zero)


def _numbered(part: Column, base: Column) -> Column:
    """Counted lines of one segment with their new-file numbers."""
    lines = F.filter(F.split(part, "\n"), lambda x: ~(
        x.startswith("-") | x.startswith(HUNK_START) | x.startswith(FILE_HEADER)))
    return F.transform(lines, lambda x, i: _line(chomp(x), base + i + 1))


def _line(x: Column, number: Column) -> Column:
    added = x.startswith("+") & ~x.startswith("+++")
    return F.struct(number.alias("line"), added.alias("added"),
                    F.when(added, F.substring(x, 2, F.length(x))).otherwise(x).alias("text"))


def segments(diff: Column) -> Column:
    """``array<struct<file, base, part>>``: pieces between points where numbering starts anew."""
    body = F.when(diff.endswith("\n"), F.left(diff, F.length(diff) - 1)).otherwise(diff)
    blocks = F.when(diff == "", strings([])).otherwise(F.split(body, _CUT_FILES))
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(b, _CUT_HUNKS),
        lambda s: F.struct(_file_of(b).alias("file"), _base(s).alias("base"), s.alias("part")))))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """One row per counted line: file, new-file line number, whether added, text without the plus."""
    return (diffs.filter(F.col("diff").isNotNull())
            .select("event_id", F.explode(segments(F.col("diff"))).alias("s"))
            .select("event_id", F.col("s.file").alias("file"),
                    F.explode(_numbered(F.col("s.part"), F.col("s.base"))).alias("l"))
            .select("event_id", "file", "l.line", "l.added", "l.text"))


def diff_hits(diff: Column) -> Column:
    """Secrets on added lines of a diff, in line order: array of ``HIT_TYPE``, no shuffle."""
    def of_segment(s: Column) -> Column:
        added = F.filter(_numbered(s["part"], s["base"]), lambda x: x["added"])
        return F.flatten(F.transform(added, lambda x: F.transform(
            secret_hits(x["text"]), lambda h: F.struct(
                s["file"].alias("file"), x["line"].alias("line"),
                h["kind"].alias("kind"), h["snippet"].alias("snippet")))))

    return F.flatten(F.transform(segments(diff), of_segment)).cast(f"array<{HIT_TYPE}>")


def line_hits(lines: DataFrame) -> DataFrame:
    """One row per secret on the added lines of ``diff_lines``."""
    return (lines.filter("added")
            .select("event_id", "file", "line", F.explode(secret_hits(F.col("text"))).alias("h"))
            .select("event_id", "file", "line", "h.kind", "h.snippet"))


def commit_hits(diffs: DataFrame) -> DataFrame:
    """Hits of every diff in order, and their number."""
    return (diffs.withColumn("hits", diff_hits(F.col("diff")))
            .withColumn("n_hits", F.coalesce(F.size("hits"), F.lit(0)).cast("bigint")))
