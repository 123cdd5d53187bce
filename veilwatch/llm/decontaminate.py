"""Benchmark decontamination by the q-gram lemma.

An occurrence of a benchmark item of m characters with at most e edits shares at least
``m - q + 1 - q * e`` character q-grams with the document, on diagonals (document position less item
position) that lie within e + 1 neighbours.  Shared q-grams are counted per item in overlapping bands
of diagonals: bands start every ``width`` diagonals and are ``width + e`` wide, so every occurrence lies
whole in one band.  Bands that reach the bound are verified by an alignment restricted to the band.

Texts are compared in lower case with runs of white space as one blank; ``start`` and ``end`` are places
in that form.  e is a tenth of the item's length, less where the bound would fall below one.

The benchmark is searched in blocks: a block holds about ``BLOCK_CHARS`` characters whatever the size
of the benchmark, is the only thing broadcast, and is held against every document in one pass.

Defined results: null and empty texts match nothing; items of fewer than q characters (after folding)
name no passage and are left out; equal items each report; repeated document rows each report; of
overlapping places of one item the one with fewest edits, then the first, is reported; an empty table on
either side gives no match.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import ship_code

Q = 8
EDIT_RATE = 0.1
MIN_WIDTH = 16
BLOCK_CHARS = 1_000_000
#: Meetings of q-gram runs looked at at once.
PAIRS = 1 << 20
#: Candidate regions aligned at once.
LANES = 128
#: Characters of a document looked at at once; a longer one is cut into pieces that overlap by more than
#: any occurrence can span.
PIECE = 1 << 20
_SLOT_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "doc_id long, item_id long, start long, end long, edits long"


def folded(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)


def _grams(points: np.ndarray) -> np.ndarray:
    """Every q-gram as a number: the low byte of each of its eight characters.

    Two different characters may share a low byte, which adds candidates and loses none; the alignment
    compares whole characters.
    """
    low = points.astype(np.uint8)
    return np.ndarray((len(low) - Q + 1,), "<u8", low.data, strides=(1,)).copy()


@dataclass
class Index:
    """The q-grams of one block of benchmark items."""

    ids: np.ndarray      # per item
    points: list         # per item, its characters
    edits: np.ndarray
    bound: np.ndarray
    width: np.ndarray
    keys: np.ndarray     # distinct q-grams, sorted
    first: np.ndarray    # where a q-gram's runs begin; one more at the end
    items: np.ndarray    # per run of a q-gram at consecutive places of an item
    at: np.ndarray
    length: np.ndarray
    slots: np.ndarray    # a bit table that settles most document q-grams at once

    @classmethod
    def build(cls, rows: list[tuple[int, str]]) -> Index:
        texts = [(i, folded(t)) for i, t in rows]
        texts = [(i, _points(t)) for i, t in texts if len(t) >= Q]
        m = np.array([len(p) for _, p in texts], np.int64)
        edits = np.minimum((m * EDIT_RATE).astype(np.int64), np.maximum(m - Q, 0) // Q)
        grams = [_grams(p) for _, p in texts]
        code = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(texts)), [len(g) for g in grams]) if grams else np.empty(0, int)
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, int)
        order = np.argsort(code, kind="stable")
        code, item, at = code[order], item[order], at[order]
        begins = np.ones(len(code), bool)
        begins[1:] = (code[1:] != code[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1)
        runs = np.flatnonzero(begins)
        keys, first = np.unique(code[runs], return_index=True)
        slots = np.zeros(1 << _SLOT_BITS, bool)
        slots[(keys * _MIX) >> np.uint64(64 - _SLOT_BITS)] = True
        return cls(np.array([i if i is not None else -1 for i, _ in texts], np.int64),
                   [p for _, p in texts], edits, m - Q + 1 - Q * edits,
                   np.maximum(MIN_WIDTH, edits + 1), keys, np.append(first, len(runs)),
                   item[runs], at[runs], np.diff(np.append(runs, len(code))), slots)


def _bands(points: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """(item, first diagonal) of the bands that reach the item's bound."""
    if len(points) < Q or not len(index.keys):
        return []
    grams = _grams(points)
    pos = np.flatnonzero(index.slots[(grams * _MIX) >> np.uint64(64 - _SLOT_BITS)])
    k = np.searchsorted(index.keys, grams[pos])
    hit = index.keys[np.minimum(k, len(index.keys) - 1)] == grams[pos]
    pos, k = pos[hit], k[hit]
    if len(pos) < index.bound.min():
        return []
    begins = np.ones(len(pos), bool)
    begins[1:] = (k[1:] != k[:-1]) | (pos[1:] != pos[:-1] + 1)
    runs = np.flatnonzero(begins)
    length, pos, k = np.diff(np.append(runs, len(pos))), pos[runs], k[runs]
    span = len(points) + 2 ** 22
    met = np.cumsum(index.first[k + 1] - index.first[k])
    parts = np.split(np.arange(len(pos)), np.searchsorted(met, np.arange(PAIRS, met[-1], PAIRS)))
    sums = [_summed(*_met(pos[p], length[p], k[p], index, span)[::2]) for p in parts if len(p)]
    keys, counts = _summed(*map(np.concatenate, zip(*sums)))
    near = keys[counts >= index.bound[keys // span]]
    if not len(near):
        return []
    seen = []
    for p in parts:
        key, at, places = _met(pos[p], length[p], k[p], index, span)
        some = near[np.minimum(np.searchsorted(near, key), len(near) - 1)] == key
        seen.append(np.unique(np.stack([key[some], at[some], places[some]]), axis=1))
    key, _, places = np.unique(np.concatenate(seen, axis=1), axis=1)  # each item place counts once
    keys, counts = _summed(key, places)
    keys = keys[counts >= index.bound[keys // span]]
    return [(int(x // span), int(x % span - 2 ** 21) * int(index.width[x // span])) for x in keys]


def _met(pos: np.ndarray, length: np.ndarray, k: np.ndarray, index: Index,
         span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of a text's q-grams meet runs of items': band (as item and band in one number), first
    item place, number of item places.

    A run of equal characters in both lies on all diagonals between its ends; every band of these counts
    the places of the whole run, which is never too few.
    """
    n = index.first[k + 1] - index.first[k]
    run = np.repeat(index.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, at, places = index.items[run], index.at[run], index.length[run]
    lowest = np.repeat(pos, n) - at - places + 1
    highest = np.repeat(pos + length, n) - 1 - at
    width = index.width[item]
    band = lowest // width
    band = band - (lowest - band * width < index.edits[item])  # also within the band before
    many = highest // width - band + 1
    each = np.repeat(np.arange(len(many)), many)
    band = band[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    return item[each] * span + (band + 2 ** 21), at[each], places[each]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)


def align(items: list[np.ndarray], texts: list[np.ndarray], diagonals: list[int],
          width: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the best alignment of each whole item within its band of diagonals.

    One row of the table per item character, for all lanes at once.  A cell holds the edits times a
    large number plus the diagonal it began on, so the start is carried along.
    """
    lanes, rows = len(items), max(map(len, items))
    big = 1 << 20
    a = np.full((lanes, rows), -1, np.int32)
    b = np.full((lanes, rows + width), -2, np.int32)
    lengths = np.array([len(i) for i in items])
    for i, (item, text, d) in enumerate(zip(items, texts, diagonals)):
        a[i, :len(item)] = item
        lo, hi = max(d, 0), min(d + rows + width, len(text))
        if hi > lo:
            b[i, lo - d:hi - d] = text[lo:hi]
    w = np.arange(width, dtype=np.int64)
    start = np.array(diagonals)[:, None] + w
    size = np.array([len(t) for t in texts])[:, None]
    inside = (start >= 0) & (start <= size)
    cur = np.where(inside, w, big * big // 2)
    out: list = [None] * lanes
    for r in range(rows):
        new = cur + np.where(a[:, r:r + 1] != b[:, r:r + width], big, 0)
        np.minimum(new[:, :-1], cur[:, 1:] + big, out=new[:, :-1])
        new = np.minimum.accumulate(new - w * big, axis=1) + w * big
        cur = new
        for i in np.flatnonzero(lengths == r + 1):
            best = int(cur[i].argmin())
            edits, began = divmod(int(cur[i, best]), big)
            out[i] = (edits, diagonals[i] + began, min(r + 1 + diagonals[i] + best, int(size[i, 0])))
    return out


def matches(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits) of every verified occurrence."""
    if not len(index.keys):
        return []
    overlap = int((np.array([len(p) for p in index.points]) + 2 * index.width + 2 * index.edits).max())
    out: dict[tuple[int, int], list] = {}
    for t, text in enumerate(texts):
        whole = folded(text)
        for at in range(0, max(1, len(whole) - overlap), PIECE):
            for i, *place in _verified(_points(whole[at:at + PIECE + overlap]), index):
                out.setdefault((t, i), []).append((place[0], place[1] + at, place[2] + at))
    kept = []
    for (t, i), places in out.items():
        taken: list[tuple[int, int]] = []  # in order, none over another
        for edits, start, end in sorted(places):
            at = bisect_left(taken, (start, end))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (start, end))
                kept.append((t, i, start, end, edits))
    return sorted(kept)


def _verified(points: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(item number, edits, start, end) of the bands of one text that hold an occurrence."""
    found = sorted(_bands(points, index), key=lambda x: len(index.points[x[0]]))  # lanes of like length
    for k in range(0, len(found), LANES):
        some = found[k:k + LANES]
        width = max(int(index.width[i] + index.edits[i]) for i, _ in some) + 1
        places = align([index.points[i] for i, _ in some], [points] * len(some), [d for _, d in some], width)
        for (i, _), (edits, start, end) in zip(some, places):
            if edits <= index.edits[i]:
                yield i, edits, start, end


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark as indexes of about ``BLOCK_CHARS`` characters."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                            F.col("text").cast("string").alias("text")).where(
        F.length("text") >= Q).distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(-(-chars // BLOCK_CHARS))
    for k in range(n):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        index = Index.build(sorted(((r[0], r[1]) for r in some.collect()),  # one bounded block
                                   key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        if len(index.ids):
            yield index


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every occurrence of a benchmark item in a document."""
    spark = docs.sparkSession
    ship_code(spark)
    out = spark.createDataFrame([], _SCHEMA)
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    for index in blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids = batch.column(0)
                rows = matches(batch.column(1).to_pylist(), own)
                t, i, start, end, edits = (np.array(x, np.int64) for x in (
                    zip(*rows) if rows else [[]] * 5))
                items = pa.array(own.ids[i], mask=own.ids[i] < 0) if len(i) else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(t)), items, *map(pa.array, (start, end, edits))], names=names)

        out = out.union(source.mapInArrow(run, _SCHEMA))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any occurrence, with all their columns."""
    ship_code(docs.sparkSession)
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                bad = {m[0] for m in matches(texts, own)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
