"""Key-value guard: a decision table over command and sub-command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.argv import kv_positional
from veilwatch.functions.text import (fill_format, marker_format, quoted, quoted_list,
                                      replace_markers, sql_literal)
from veilwatch.functions.verdicts import allow, block, threat, warn
from veilwatch.rules import kv_rules as K

_SEP = "\u001f"
_MARKERS = ["mod", "sub", "rest", "rest2", "third", "host", "port"]


def _decision(command: Column, sub: Column) -> Column:
    """The row for (command, sub-command), else the row for any sub-command."""
    rows = ", ".join(
        sql_literal(r.command + _SEP + r.sub) + f", named_struct('verdict', {sql_literal(r.verdict)}, "
        f"'subject', {sql_literal(marker_format(r.subject, _MARKERS))}, "
        f"'detail', {sql_literal(marker_format(r.detail, _MARKERS))}, "
        f"'missing', {sql_literal(r.missing)})" for r in K.KV_RULES)
    table = F.expr(f"map({rows})")
    exact = F.try_element_at(table, F.concat(command, F.lit(_SEP), sub))
    return F.coalesce(exact, F.try_element_at(table, F.concat(command, F.lit(_SEP + "*"))))


def with_kv_outcome(df: DataFrame, out: str = "outcome", gate: Column | None = None) -> DataFrame:
    gate = F.lit(True) if gate is None else gate
    args, row = F.col("_kv"), F.col("_kv_row")
    item = lambda n: F.try_element_at(args, F.lit(n))
    command, sub, third = item(1), item(2), item(3)
    keys = F.size(args) - 1
    rest = lambda n: F.slice(args, F.lit(n), F.greatest(F.size(args), F.lit(1)))
    values = {
        "mod": F.coalesce(sub, F.lit("none")),
        "sub": F.coalesce(sub, row["missing"]),
        "rest": quoted_list(rest(2)),
        "rest2": quoted_list(rest(3)),
        "third": F.when(third.isNull(), "None")
                  .otherwise(F.concat(F.lit("Some("), quoted(third), F.lit(")"))),
        "host": F.coalesce(sub, F.lit("?")),
        "port": F.coalesce(third, F.lit("?")),
    }
    detail = F.array(fill_format(row["detail"], values))
    subject = fill_format(row["subject"], values)
    mass = command.isin(K.MASS_DELETE_COMMANDS) & (keys >= K.MASS_DELETE_KEYS)
    mass_detail = replace_markers(K.MASS_DELETE_DETAIL, {"keys": keys.cast("string")})
    outcome = (F.when(row["verdict"] == "Block",
                      block(threat(K.BLOCK_CODE, "redis-cli", subject, detail)))
               .when(row["verdict"] == "Warn",
                     warn(threat(K.WARN_CODE, "redis-cli", subject, detail)))
               .when(mass, warn(threat(K.WARN_CODE, "redis-cli", command, F.array(mass_detail))))
               .otherwise(allow()))
    return (df.withColumn("_kv", F.when(gate, kv_positional()))
            .withColumn("_kv_row", _decision(command, sub))
            .withColumn(out, F.when(gate, outcome)).drop("_kv", "_kv_row"))
