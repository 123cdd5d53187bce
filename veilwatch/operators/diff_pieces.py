"""Diffs larger than a row: stored in pieces, numbered as if they were whole.

A diff is rows ``(event_id, piece, text)``; the texts in order of ``piece`` make the diff, cut anywhere,
also inside a line.  Prefix sums over the pieces in two levels (within groups of pieces, then over the groups)
say which lines a piece has parts of; the parts of a line are put together where its group of lines is.  What
a line needs from before its group is three values, carried over the groups in the same way: how many lines
were counted, how far the numbering was moved by the last header, and the last file.  So a diff of any size is
spread over as many tasks as it has groups; only a single line has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwatch.functions.text import chomp
from veilwatch.operators.diffs import FILE_HEADER, HUNK_START, hunk_start
from veilwatch.operators.prefix import GROUP, before
from veilwatch.session import written

#: Characters of a piece where the library cuts diffs itself.
PIECE = 1 << 20
_KEY, _PIECE, _LINES = "event_id", ["event_id", "piece"], ["event_id", "_l"]


def cut_diffs(diffs: DataFrame, size: int = PIECE) -> DataFrame:
    """Pieces of at most ``size`` characters of diffs that come whole."""
    parts = F.regexp_extract_all("diff", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return diffs.filter(F.col("diff").isNotNull()).select("event_id", F.posexplode(parts).alias("piece", "text"))


def _joined(*order: str) -> Column:
    """The parts of one line put together in order."""
    parts = F.sort_array(F.collect_list(F.struct(*order, "part")))
    return F.array_join(F.transform(parts, lambda p: p["part"]), "")


def whole_lines(pieces: DataFrame, group: int = GROUP) -> DataFrame:
    """``event_id``, ``_l``, ``nth``, ``line_text``: every line with its place in the diff, dealt by ``event_id``
    and ``_l``, a group of lines that follow each other.

    Texts are dealt twice: by groups of pieces, to learn how many lines were before, and by groups of lines.  What
    a line has in one group of pieces is one part; between the two the parts are written, so that what the
    first dealing left on disk is gone before the second.
    """
    text = F.coalesce("text", F.lit(""))
    cut = pieces.select(*_PIECE, text.alias("text"), F.regexp_count(text, F.lit("\n")).cast("bigint").alias("breaks"))
    cut = before(_KEY, cut, ["breaks"], [], group, ("text",), grouped=True)
    parts = cut.select(_KEY, "_g", "piece", "breaks", "breaks_all", F.posexplode(F.split("text", "\n")).alias("at", "part"))
    parts = parts.groupBy(_KEY, "_g", (F.col("breaks") + F.col("at")).alias("nth")).agg(
        _joined("piece", "at").alias("part"), F.max("breaks_all").alias("ending"))
    parts = written(parts, lean=True).withColumn("_l", F.floor(F.col("nth") / group))
    # with the filter both readers of the lines need the same rows, so that they share one shuffle
    parts = parts.filter("event_id is not null and _l is not null").repartition(*_LINES)
    lines = parts.groupBy(_KEY, "_l", "nth").agg(_joined("_g").alias("line_text"), F.max("ending").alias("ending"))
    # what follows the last line break is no line when it is empty
    return lines.filter("nth < ending or line_text <> ''").drop("ending")


def pieced_diff_lines(pieces: DataFrame, group: int = GROUP) -> DataFrame:
    """The rows of ``diffs.diff_lines`` for diffs in pieces."""
    text = F.col("line_text")
    header = text.startswith(FILE_HEADER)
    start = F.when(text.startswith(HUNK_START), hunk_start(text))
    name = chomp(F.substring("line_text", len(FILE_HEADER) + 1, F.length("line_text")))
    counted = ~(text.startswith("-") | text.startswith(HUNK_START) | header)
    upto = Window.partitionBy(*_LINES).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(_KEY).orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    lines = whole_lines(pieces, group).select(
        *_LINES, "nth", "line_text", counted.alias("counted"), F.when(header, name).alias("named"),
        F.when(header | start.isNotNull(), F.greatest(F.coalesce(start, zero) - 1, zero)).alias("base"))
    lines = lines.withColumn("seen", F.sum(F.col("counted").cast("bigint")).over(upto))
    lines = lines.select(
        *_LINES, "nth", "line_text", "counted", "seen", F.last("named", ignorenulls=True).over(upto).alias("file"),
        F.last(F.col("base") - F.col("seen"), ignorenulls=True).over(upto).alias("moved"))
    ends = lines.groupBy(*_LINES).agg(F.max("seen").alias("seen"), F.max_by("moved", "nth").alias("moved"),
                                      F.max_by("file", "nth").alias("file"))
    ends = ends.withColumn("_seen", F.coalesce(F.sum("seen").over(earlier), zero))
    given = ends.select(*_LINES, "_seen", F.last(F.col("moved") - F.col("_seen"), ignorenulls=True).over(earlier).alias("_moved"),
                        F.last("file", ignorenulls=True).over(earlier).alias("_file"))
    number = F.col("seen") + F.coalesce("moved", F.col("_seen") + F.coalesce("_moved", zero))
    body = chomp(text)
    added = body.startswith("+") & ~body.startswith("+++")
    return lines.join(given, _LINES).filter("counted").select(
        "event_id", F.coalesce("file", "_file", F.lit("")).alias("file"), number.alias("line"),
        added.alias("added"), F.when(added, F.substring(body, 2, F.length(body))).otherwise(body).alias("text"))
