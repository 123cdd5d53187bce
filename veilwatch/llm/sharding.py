"""Sharding by extendible hashing.

Every row has a 128-bit hash.  A directory is indexed by the first bits of the hash; a bucket that is
over the byte limit splits on its next bit, until every bucket fits, so a shard is the shortest prefix
of bits whose rows fit.  Buckets that fit are never split further.

Rows are first summed by a prefix that is a few bits longer than an even spread would need, and the
sums of all shorter prefixes follow from those few rows.  Only prefixes that are still too large at that
depth go on with more bits.  What the driver reads is one count per such round.

Equal rows (same doc_id and text) differ in the second 64 bits, which hash their number among the
copies: a group of copies of any size is counted first and dealt out from the count, a large one in chunks
of ``COPIES`` that are spread over the tasks.

Defined results: a null text has no bytes; a row over the limit is a shard of its own (it cannot fit
any); repeated rows each get a place; null ids hash like any value; an empty table gives no shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import ROW, digest, field, pack_row, settled, unpack_row

LIMIT_BYTES = 1 << 26
BITS = 128
#: Bits beyond an even spread in the first round, and in every later one.
SLACK = 4
#: Equal rows that one task makes of one count.
COPIES = 1 << 16


def _prefix(depth: Column) -> Column:
    """The first ``depth`` of the 128 bits ``h1``, ``h2``, as two longs with zeros behind."""
    def head(h: str, d: Column) -> Column:
        ones = F.lit(-1).cast("long")
        keep = F.when(d <= 0, F.lit(0).cast("long")).when(d >= 64, ones).otherwise(
            F.call_function("shiftleft", ones, F.lit(64) - d))
        return F.col(h).bitwiseAND(keep)

    return F.struct(head("h1", depth).alias("p1"), head("h2", depth - 64).alias("p2"))


def _rows(docs: DataFrame) -> DataFrame:
    """Packed rows with a hash over all their columns, so that rows of one hash are interchangeable."""
    df = pack_row(docs)
    every = [F.map_entries(field_of) if kind.typeName() == "map" else field_of
             for field_of, kind in ((F.col(ROW).getField(f.name), f.dataType)
                                    for f in df.schema[ROW].dataType.fields)]
    text = field(df, "text", "string")
    return df.withColumns({"doc_id": field(df, "doc_id", "long"), "h1": digest(*every),
                           "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})


def _placed(counted: DataFrame) -> DataFrame:
    """Every copy of a counted row with its own second hash."""
    def dealt(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        copy = rows.withColumn("copy", F.explode(F.sequence(first, last)))
        return copy.select(*counted.columns, F.xxhash64("h1", "copy").alias("h2"))

    end = F.col("n") - 1
    few = dealt(counted.where(F.col("n") <= COPIES), F.lit(0).cast("long"), end)
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start = F.explode(F.sequence(F.lit(0).cast("long"), end, F.lit(COPIES).cast("long")))
    chunks = counted.where(F.col("n") > COPIES).withColumn("start", start).repartition(tasks, "h1", "start")
    many = dealt(chunks, F.col("start"), F.least(F.col("start") + COPIES - 1, end))
    return few.unionByName(many)


def assign(placed: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """Rows with ``h1``, ``h2``, ``n_bytes`` and their shard's ``depth`` and prefix (``p1``, ``p2``)."""
    placed = settled(placed)
    large = placed.where(F.col("n_bytes") > limit).withColumns(
        {"depth": F.lit(BITS), "p1": F.col("h1"), "p2": F.col("h2")})
    left = placed.where(F.col("n_bytes") <= limit)
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    depth, base = min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + SLACK), 0
    out = [large]
    while True:
        leaves = left.groupBy(_prefix(F.lit(depth)).alias("leaf")).agg(
            F.sum("n_bytes").alias("bytes"))
        levels = leaves.select("leaf", "bytes", F.col("leaf.p1").alias("h1"),
                               F.col("leaf.p2").alias("h2"),
                               F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth"))
        levels = levels.select("leaf", "depth", "bytes", _prefix(F.col("depth")).alias("p"))
        fits = levels.groupBy("depth", "p").agg(F.sum("bytes").alias("all")).where(
            (F.col("all") <= limit) | (F.col("depth") == BITS))
        chosen = settled(levels.join(fits, ["depth", "p"], "left").groupBy("leaf").agg(
            F.min(F.when(F.col("all").isNotNull(), F.struct("depth", "p"))).alias("b")))
        rows = left.withColumn("leaf", _prefix(F.lit(depth))).join(chosen, "leaf")
        out.append(rows.where("b is not null").select(
            *placed.columns, "b.depth", F.col("b.p.p1").alias("p1"), F.col("b.p.p2").alias("p2")))
        over = chosen.where("b is null").count()
        if not over:
            break
        left = settled(rows.where("b is null").select(*placed.columns))
        base, depth = depth + 1, min(BITS, depth + SLACK)
    done = out[0]
    for part in out[1:]:
        done = done.unionByName(part)
    return done


def shard_name() -> Column:
    """A shard's depth and the bits of its prefix, as text."""
    bits = F.concat(F.lpad(F.bin("p1"), 64, "0"), F.lpad(F.bin("p2"), 64, "0"))
    return F.concat(F.lpad(F.col("depth").cast("string"), 3, "0"), F.lit("-"),
                    F.substring(bits, F.lit(1), F.col("depth")))


def shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``shard_id`` and ``depth``."""
    return _named(_rows(docs), limit).select("doc_id", "n_bytes", "shard_id", "depth")


def _named(rows: DataFrame, limit: int) -> DataFrame:
    counted = settled(rows.groupBy("doc_id", "h1", "n_bytes").agg(F.count(F.lit(1)).alias("n")))
    return assign(_placed(counted).select("doc_id", "h1", "h2", "n_bytes"), limit).select(
        "doc_id", "h1", "n_bytes", shard_name().alias("shard_id"), "depth")


def sharded_rows(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """The documents with all their columns and ``shard_id``.

    Equal rows travel once with their places and are dealt out to them.
    """
    rows = _rows(docs)
    once = rows.groupBy("h1").agg(F.first(ROW).alias(ROW))
    placed = once.join(_named(rows, limit).select("h1", "shard_id"), "h1")
    return unpack_row(placed, shard_id=F.col("shard_id"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """One folder per shard, each written by one task."""
    sharded_rows(docs, limit).repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def directory(sharded: DataFrame) -> DataFrame:
    """One row per shard: its rows and bytes and how many slots of the directory point to it."""
    per = sharded.groupBy("shard_id", "depth").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
    top = sharded.where(F.col("depth") < BITS).agg(F.max("depth")).first()[0] or 0
    return per.withColumn("slots", F.when(F.col("depth") < BITS,
                                          F.pow(F.lit(2.0), F.lit(top) - F.col("depth"))))
