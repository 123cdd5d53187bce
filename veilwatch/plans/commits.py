"""Commit guard: secrets on the added lines of a staged diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.verdicts import allow, block, threat
from veilwatch.operators.diffs import diff_hits
from veilwatch.sources.contents import newest_diffs

NOT_RECORDED = "no staged diff was recorded for this commit"


def diff_facts(diffs: DataFrame) -> DataFrame:
    """What the guard needs of each diff; the text itself stays behind."""
    return diffs.select(
        "event_id", F.lit(True).alias("recorded"), F.size("files").alias("n_files"), "error",
        (F.coalesce(F.col("diff"), F.lit("")) == "").alias("empty_diff"),
        diff_hits(F.col("diff")).alias("hits"))


def with_diff_facts(cmds: DataFrame, diffs: DataFrame) -> DataFrame:
    """Join the facts of the diffs the commits saw; no pattern runs over any other diff."""
    return cmds.join(diff_facts(newest_diffs(cmds, diffs)), "event_id", "left")


def hit_text(hit: Column) -> Column:
    return F.concat(hit["file"], F.lit(":"), hit["line"].cast("string"), F.lit(" · "),
                    hit["kind"], F.lit(" → "), hit["snippet"])


def with_commit_outcome(df: DataFrame, out: str = "outcome", gate: Column | None = None) -> DataFrame:
    """Without a working directory nothing can be inspected: allow.  A failed inspection blocks, an
    empty change allows, hits block."""
    gate = F.lit(True) if gate is None else gate
    failed = lambda detail: block(threat(
        "GIT_COMMIT_INSPECT_FAILED", "git", None, F.array(detail)))
    hits = F.col("hits")
    outcome = (F.when(F.col("cwd").isNull(), allow())
               .when(F.col("recorded").isNull(), failed(F.lit(NOT_RECORDED)))
               .when(F.coalesce(F.col("n_files"), F.lit(-1)) == 0, allow())
               .when(F.col("error").isNotNull(), failed(F.col("error")))
               .when(F.col("empty_diff"), allow())
               .when(F.size(hits) > 0,
                     block(threat("SECRET_LEAK", "git", None, F.transform(hits, hit_text))))
               .otherwise(allow()))
    return df.withColumn(out, F.when(gate, outcome))
