"""SimHash near-dedup by the generalised pigeonhole principle.

A 64-bit fingerprint is the majority vote of the XXH64 values of a text's word shingles.  Fingerprints
link at ``distance`` or fewer differing bits.  Candidates come from a partition of the 64 bits:

* bits that vary together are put into the same part (correlations over all fingerprints, a 64 x 64
  matrix), so that the parts are as independent of each other as possible;
* every probing fingerprint gets a threshold per part, from -1 (the part is left out) to ``distance``,
  that add up to ``distance - parts + 1``.  Two fingerprints within ``distance`` must agree within the
  threshold in at least one part, whatever the thresholds;
* the thresholds are chosen by dynamic programming on estimated candidate counts: the bucket's own
  count at threshold 0, and at a radius the number of probed values times the part's mean bucket, so a
  fingerprint whose value in one part is very common probes the other parts more widely instead;
* the probed values are joined with the parts' values, and pairs are verified on all 64 bits.

Exact copies are one row before any probing.  Links go through connected components.

Defined results: null or empty text has fingerprint zero and links like any other; a null doc_id never
names a component unless all ids of it are null (then it is null); repeated rows get the same answer;
extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import ROW, digest, field, id_key, pack_row, settled, ship_code, unpack_row
from veilwatch.llm.components import components

BITS = 64
SHINGLE = 3
DISTANCE = 2
PARTS = 3
_hash = partial(xxhash.xxh64_intdigest, seed=42)
#: Shingles voted at once, which bounds the memory of a very long text.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at:at + CHUNK + shingle - 1] if n > CHUNK else words
        grams = map(b" ".join, zip(*[part[k:] for k in range(shingle)])) if len(part) >= shingle \
            else [b" ".join(part)]
        h = np.fromiter(map(_hash, grams), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str, shingle: int = SHINGLE) -> DataFrame:
    """``fp`` as a signed long beside every other column; ``text`` goes."""
    ship_code(df.sparkSession)
    rest = [c for c in df.columns if c != text]
    schema = df.select(*rest, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64,
                              len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in rest] + [pa.array(fps)],
                names=[*rest, "fp"])

    return df.mapInArrow(run, schema)


def bit_sums(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how many set both bits, for every two bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(h, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], names=["i", "v"])

    rows = fps.select("fp").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    found = dict(rows.collect())  # 64 x 64 + 1 numbers at any input size
    flat = np.array([found.get(i, 0.0) for i in range(BITS * BITS + 1)])
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Parts of nearly equal size; each takes the free bit most correlated with what it has."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        first = free.pop(0)
        mine = [first]
        while len(mine) < size:
            best = max(free, key=lambda b: (round(float(corr[b, mine].sum()), 9), -b))
            free.remove(best)
            mine.append(best)
        out.append(sorted(mine))
    return out


def part_value(fp: Column, bits: list[int]) -> Column:
    """The fingerprint with only the part's bits."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long"))


def _flips(bits: list[int], radius: int) -> list[int]:
    """The masks that flip up to ``radius`` of the bits."""
    masks = [0]
    for at in range(1, radius + 1):
        masks += _choose(bits, at)
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _choose(bits: list[int], k: int) -> list[int]:
    if k == 0:
        return [0]
    return [1 << b | rest for i, b in enumerate(bits) for rest in _choose(bits[i + 1:], k - 1)]


def thresholds(costs: np.ndarray, distance: int) -> np.ndarray:
    """Per row the threshold of each part that minimises the summed cost.

    ``costs[row, part, t + 1]`` is the estimated number of candidates at threshold t from -1 on.
    Dynamic programming over parts and the sum of thresholds so far.
    """
    rows, parts, levels = costs.shape
    total = distance + 1  # the sum of (t + 1) over the parts
    best = np.full((rows, total + 1), np.inf)
    best[:, 0] = 0
    picks = np.zeros((parts, rows, total + 1), np.int8)
    for p in range(parts):
        now = np.full_like(best, np.inf)
        for s in range(total + 1):
            for level in range(min(s, levels - 1) + 1):
                cost = best[:, s - level] + costs[:, p, level]
                better = cost < now[:, s]
                now[better, s] = cost[better]
                picks[p, better, s] = level
        best = now
    out = np.zeros((rows, parts), np.int8)
    left = np.full(rows, total)
    for p in reversed(range(parts)):
        out[:, p] = picks[p, np.arange(rows), left]
        left = left - out[:, p]
    return out - 1


def links(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints (``fp``, unique) at ``distance`` or fewer bits."""
    groups = group_bits(*bit_sums(fps), parts)
    values = [part_value(F.col("fp"), g).alias(f"v{i}") for i, g in enumerate(groups)]
    table = fps.select("fp", *values)
    index = table.select("fp", F.explode(F.array(*[F.struct(
        F.lit(i).alias("part"), F.col(f"v{i}").alias("value")) for i in range(parts)])).alias("x")
        ).select("x.part", "x.value", "fp")
    buckets = settled(index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("c")))
    mean = {r["part"]: float(r["mean"]) for r in buckets.groupBy("part").agg(
        (F.sum(F.col("c").cast("double") ** 2) / F.sum("c")).alias("mean")).collect()}  # one per part
    probes = [[_flips(g, t) for t in range(distance + 1)] for g in groups]
    for i in range(parts):
        own = buckets.where(F.col("part") == i).select(F.col("value").alias(f"v{i}"),
                                                       F.col("c").alias(f"c{i}"))
        table = table.join(own, f"v{i}")
    levels = distance + 2

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(parts)]
            costs = np.zeros((batch.num_rows, parts, levels))
            for i in range(parts):
                for t in range(distance + 1):  # the probes themselves cost a row each
                    costs[:, i, t + 1] = counts[i] + (len(probes[i][t]) - 1) * mean.get(i, 1.0) \
                        + len(probes[i][t])
            taken = thresholds(costs, distance)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(taken[:, i].astype(np.int32)) for i in range(parts)]],
                names=["fp", *[f"t{i}" for i in range(parts)]])

    chosen = table.select("fp", *[f"c{i}" for i in range(parts)]).mapInArrow(
        choose, "fp long, " + ", ".join(f"t{i} int" for i in range(parts)))
    masks = F.concat(*[_probed(i, F.col(f"t{i}"), groups[i], probes[i]) for i in range(parts)])
    probing = chosen.select(F.col("fp").alias("q"), F.explode(masks).alias("x")).select(
        "q", "x.part", "x.value")
    found = probing.join(index, ["part", "value"]).where(
        (F.col("q") != F.col("fp"))
        & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= distance))
    return found.select(F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b")).distinct()


def _probed(i: int, level: Column, bits: list[int], masks: list[list[int]]) -> Column:
    """The values of part ``i`` to probe at a threshold, as an array of (part, value)."""
    flips = F.array().cast("array<long>")
    for t, some in enumerate(masks):
        flips = F.when(level == t, F.array(*[F.lit(m).cast("long") for m in some])).otherwise(flips)
    own = part_value(F.col("fp"), bits)
    return F.transform(flips, lambda m: F.struct(
        F.lit(i).alias("part"), own.bitwiseXOR(m).alias("value")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: ``k1``, ``k2`` (its key), ``doc_id``, ``fp`` and ``component_id``."""
    df = pack_row(docs)
    doc_id, text = field(df, "doc_id", "long"), field(df, "text", "string")
    prints = settled(with_fingerprint(df.select(
        id_key(doc_id).alias("k1"), digest(text).alias("k2"), doc_id.alias("doc_id"),
        text.alias("text")), "text", shingle))
    fps = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = settled(components(links(fps, distance)))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("k1", "k2", "doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of every group: the smallest doc_id, and of equal ids one row."""
    found = near_duplicates(docs, shingle, distance)
    group = F.coalesce(F.col("component_id"), F.lit(None).cast("long"))
    first = (found.withColumn("grp", F.struct(group.isNull().alias("n"), group.alias("c"),
                                              F.when(group.isNull(), F.col("fp")).alias("f")))
             .groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "k1", "k2"))
                                 .alias("first")).select("first.k1", "first.k2"))
    df = pack_row(docs)
    df = df.withColumn("k1", id_key(field(df, "doc_id", "long"))).withColumn(
        "k2", digest(field(df, "text", "string")))
    kept = df.join(first, ["k1", "k2"], "left_semi")
    return unpack_row(_one_of_each(kept))


def _one_of_each(df: DataFrame) -> DataFrame:
    """One row of each key: rows of one key are pre-aggregated where they lie."""
    return df.groupBy("k1", "k2").agg(F.first(ROW).alias(ROW)).select(ROW)
