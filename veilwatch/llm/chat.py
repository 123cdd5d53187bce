"""Chat formatting with collapse of cumulative snapshots.

A logged conversation that is a prefix of a longer one is an earlier snapshot of it.  Every prefix of
turns has a rolling 128-bit hash: the hash of a turn and its number, combined with that of the prefix
before it.  A conversation whose whole hash is among the proper prefixes of others goes by an anti-join;
of equal conversations the one with the smallest id stays.  Only what stays is rendered.

The hash rows are narrow; texts move once, for the conversations that stay.  The prefixes are
pre-aggregated to one row each before the join, and the join is split by Spark where a hash is hot.  The
hash rows of one conversation are numbered together; a conversation is rendered into one row, so its
length is bounded by what a row can hold.

Defined results: turns are ordered by turn, then role, then text; rows equal in all four columns count
once; a row without conv_id is a conversation of its own, of one turn; a null turn number comes first;
null role renders as ``unknown``, null text as empty; markers inside a text are broken by a blank; an
empty table gives no row; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwatch.llm.common import field, pack_row

START, END = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """The turns under private names: ``c`` (conversation key), ``conv_id``, ``turn``, ``role``, ``text``."""
    df = pack_row(conversations)
    df = df.select(field(df, "conv_id", "long").alias("conv_id"), field(df, "turn", "long").alias("turn"),
                   field(df, "role", "string").alias("role"), field(df, "text", "string").alias("text"))
    alone = F.xxhash64("turn", F.col("turn").isNull(), "role", F.col("role").isNull(), "text",
                       F.col("text").isNull())
    return df.withColumn("c", F.struct(F.col("conv_id").alias("id"), F.when(
        F.col("conv_id").isNull(), alone).alias("own")))


def prefixes(rows: DataFrame) -> DataFrame:
    """One row per turn: its number ``k`` of ``n`` and the hash ``p1``, ``p2`` of the turns up to it."""
    role, text = F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0"))
    narrow = rows.select("c", "conv_id", "turn", F.xxhash64(role, text).alias("a"),
                         F.xxhash64(F.lit(1), role, text).alias("b"),
                         F.xxhash64(role).alias("r")).distinct()
    order = W.partitionBy("c").orderBy("turn", "r", "a", "b")
    numbered = narrow.withColumn("k", F.row_number().over(order))
    upto = W.partitionBy("c").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return numbered.select(
        "c", "conv_id", "k", F.count(F.lit(1)).over(W.partitionBy("c")).alias("n"),
        F.bit_xor(F.xxhash64("k", "a")).over(upto).alias("p1"),
        F.bit_xor(F.xxhash64("b", "k")).over(upto).alias("p2"))


def maximal(rows: DataFrame) -> DataFrame:
    """The conversations that are no prefix of a longer one: ``c``, ``conv_id``, ``n``, ``copies``."""
    every = prefixes(rows)
    whole = every.where("k = n").groupBy("n", "p1", "p2").agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("copies"))
    proper = every.where("k < n").select(F.col("k").alias("n"), "p1", "p2").distinct()
    return whole.join(proper, ["n", "p1", "p2"], "left_anti").select("c", "n", "copies")


def _safe(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for marker in (START, END):
        out = F.replace(out, F.lit(marker), F.lit(marker.replace("<|", "<| ")))
    return out


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), _safe(F.coalesce(turn["role"], F.lit("unknown"))), F.lit("\n"),
                    _safe(turn["text"]), F.lit(END), F.lit("\n"))


def chats(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: ``conv_id``, ``n_turns``, ``copies`` and the rendered ``text``."""
    rows = turns(conversations)
    kept = maximal(rows)
    role, text = F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0"))
    whole = rows.join(kept, "c").groupBy("c").agg(
        F.first("n").alias("n"), F.first("copies").alias("copies"),
        F.collect_set(F.struct("turn", F.xxhash64(role).alias("r"), F.xxhash64(role, text).alias("a"),
                               F.xxhash64(F.lit(1), role, text).alias("b"), "role", "text")).alias("t"))
    return whole.select(F.col("c.id").alias("conv_id"), F.col("n").cast("long").alias("n_turns"),
                        F.col("copies").cast("long").alias("copies"),
                        F.array_join(F.transform(F.sort_array("t"), rendered), "").alias("text"))
