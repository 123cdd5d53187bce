"""Messages, report rows and report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.text import (clip_bytes, fill_format, marker_format, string_map,
                                      strings, text_lines, trim_ws)
from veilwatch.rules import threat_texts as T


_MARKERS = ["code", "tool", "subject", "n", "first", "list"]


def _templates(pairs) -> Column:
    return string_map((code, marker_format(text, _MARKERS)) for code, text in pairs if text is not None)


def _message(code: Column, tool: Column, subject: Column, details: Column) -> Column:
    """Head, one line per detail, tail; the templates are looked up by code."""
    values = dict(zip(_MARKERS, [
        code, tool, subject, F.size(details).cast("string"), F.get(details, 0),
        F.array_join(details, ", ")]))
    fill = lambda fmt: fill_format(fmt, values)
    head = F.try_element_at(_templates((c, m.head) for c, m in T.MESSAGES.items()), code)
    head = F.when((code == "DOCKER_EXEC") & F.array_contains(details, "privileged"),
                  marker_format(T.EXEC_PRIVILEGED_HEAD, _MARKERS)).otherwise(head)
    item = F.try_element_at(string_map((c, m.item) for c, m in T.MESSAGES.items() if m.item), code)
    tail = F.try_element_at(_templates((c, m.tail) for c, m in T.MESSAGES.items()), code)
    columns = F.when((code == "DATA_POLICY_BLOCK") & (F.size(details) > 0),
                     marker_format(T.PROTECTED_COLUMNS_LINE, _MARKERS))
    items = F.when(item.isNull(), strings([])).otherwise(
        F.transform(details, lambda d: F.concat(item, d)))
    lines = F.concat(F.array(fill(head)), items, F.array(fill(columns)), F.array(fill(tail)))
    return F.when(code.isNotNull(), F.array_join(lines, "\n"))


def threat_message(threat: Column) -> Column:
    """The text of a threat; a cluster threat shows its inner threat below its own line."""
    code, tool, details = threat["code"], threat["tool"], threat["details"]
    own = _message(code, tool, threat["subject"], details)
    inner = _message(threat["inner_code"], tool, threat["subject"], details)
    # a cluster threat's own line takes no details: they belong to the inner threat
    return F.when(code == "KUBECTL_SQL_THREAT",
                  F.concat(own, F.lit("\n  "), inner)).otherwise(own)


def report_kind(verdict: Column) -> Column:
    """BLOCKED or WARNING; null for allowed commands, which are not reported."""
    return F.coalesce(*[F.when(verdict == v, F.lit(k)) for v, k in T.REPORT_KIND.items()])


def build_reports(verdicts: DataFrame) -> DataFrame:
    """Report rows of blocked and warned commands, with the local calendar day to partition by."""
    return (verdicts.filter(F.col("verdict").isin(list(T.REPORT_KIND)))
            .select("event_id", "host", "ts", report_kind(F.col("verdict")).alias("kind"),
                    F.col("threat.code").alias("code"), F.col("action").alias("tool"), "pid",
                    F.array_join("argv", " ").alias("command"),
                    threat_message(F.col("threat")).alias("detail"), "stale",
                    F.to_date("ts").alias("report_date")))


def report_text() -> Column:
    """The text block of a report row."""
    lines = [F.lit(T.REPORT_TOP),
             F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("]  "),
                      F.col("kind"), F.lit("  ["), F.col("code"), F.lit("]")),
             F.concat(F.lit("Tool:    "), F.col("tool")),
             F.concat(F.lit("PID:     "), F.col("pid").cast("string")),
             F.concat(F.lit("Command: "), F.col("command")),
             F.lit(""), F.col("detail"), F.lit(T.REPORT_BOTTOM), F.lit(""), F.lit("")]
    return F.concat_ws("\n", *lines)


def detail_lines(detail: Column, n: int = T.DETAIL_LINES, size: int = T.DETAIL_BYTES) -> Column:
    """The first lines of a message that hold text, trimmed and clipped to a number of bytes."""
    lines = F.filter(F.transform(text_lines(detail), lambda x: trim_ws(x)), lambda x: x != "")
    return F.transform(F.slice(lines, 1, n), lambda x: clip_bytes(x, size))
