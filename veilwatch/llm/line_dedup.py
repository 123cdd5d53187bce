"""Line dedup by overlapping windows of three consecutive lines.

Every window of three lines is hashed; a window that occurred before, anywhere in the corpus, is a
later occurrence, and the lines that such windows cover are removed.  Covered positions of overlapping
windows merge, so a repeated passage of any length from three lines goes as one piece.  The first
occurrence stays: the smallest (doc_id, text hash, position), null ids last.
Where a later occurrence overlaps it, the lines that both cover go too: five equal lines become one.

Only hashes and positions are shuffled; a window's copies are pre-aggregated to its first place and
the join against that one row per window is split by Spark where a window is hot.

Defined results: null text stays null, a text of fewer than three lines is left whole; rows that agree
in doc_id and text count as one document and come out alike; an empty table gives an empty result;
extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import digest, field, id_key, pack_row, unpack_row

WINDOW = 3


def _keyed(docs: DataFrame) -> DataFrame:
    df = pack_row(docs)
    text = field(df, "text", "string")
    return df.withColumn("k1", id_key(field(df, "doc_id", "long"))).withColumn(
        "k2", digest(text))


def windows(df: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per window: the document's key, ``pos`` and a 128-bit ``w1``, ``w2``."""
    lines = df.select("k1", "k2", F.split(field(df, "text", "string"), "\n").alias("lines")).where(F.size("lines") >= width)
    hashed = lines.select("k1", "k2", F.transform("lines", lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("h"))
    n = F.size("h") - (width - 1)

    def over(i, part: str):
        return F.xxhash64(*[F.get(F.col("h"), i + k)[part] for k in range(width)])

    at = F.posexplode(F.transform(F.slice("h", 1, n), lambda _, i: F.struct(
        over(i, "a").alias("w1"), over(i, "b").alias("w2"))))
    return hashed.select("k1", "k2", at.alias("pos", "w")).select("k1", "k2", "pos", "w.w1", "w.w2")


def repeated_positions(df: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document with later occurrences: the sorted line positions they cover."""
    every = windows(df, width)
    place = F.struct((F.col("k1") == -(2 ** 63)).alias("last"), "k1", "k2", "pos")
    first = (every.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("end"))
             .where("first < end").select("w1", "w2", "first"))
    later = every.join(first, ["w1", "w2"]).where(
        F.struct((F.col("k1") == -(2 ** 63)).alias("last"), "k1", "k2", "pos") > F.col("first"))
    starts = later.groupBy("k1", "k2").agg(F.collect_set("pos").alias("starts"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "starts", lambda p: F.sequence(p, p + (width - 1))))))
    return starts.select("k1", "k2", covered.alias("covered"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents with later occurrences removed, and ``n_lines`` and ``n_removed``."""
    df = _keyed(docs)
    joined = df.join(repeated_positions(df, width), ["k1", "k2"], "left")
    whole = field(joined, "text", "string")
    joined = joined.withColumn("lines", F.split(whole, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    joined = joined.withColumn("kept", F.when(F.col("covered").isNotNull(), kept))
    text = F.when(F.col("covered").isNull(), whole).otherwise(
        F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n"))
    return unpack_row(joined, text=text,
                      n_lines=F.coalesce(F.size("lines"), F.lit(0)).cast("long"),
                      n_removed=F.coalesce(F.size("covered"), F.lit(0)).cast("long"))


def dedup_documents(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents with the same columns; ``n_chars`` follows the new text."""
    out = dedup_lines(docs, width)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
