"""Packing of tokenised examples into sequences by vector bin packing.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.  Texts are tokenised
once, cut into pieces of at most a sequence, and the pieces are written as a narrow table.  A piece
that fills a sequence is one by itself; the others are dealt into groups of about ``GROUP`` pieces, in
which the dot-product heuristic fills one sequence after the other: of the pieces that fit, it takes
the one whose demand, weighted by the mean demand per dimension, has the largest product with what the
sequence has left.

Groups are dealt by the written table's row numbers, so equal rows spread like any others, no group
grows with the input, and a lost executor deals them the same way again.

Defined results: a null or empty text is its end token alone; repeated rows are packed once each; ties
go to the larger, then the earlier piece; extra columns are not carried; an empty table gives none.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import field, pack_row, settled, ship_code

LENGTH = 1024
SEGMENTS = 64
END_ID = 0
GROUP = 4096
_PIECES = "doc_id long, start long, length long, loss long, ids_crc32 long, doc_tokens long"


@cache
def _encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _tokenizer(json_path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(json_path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def token_ids(text: str | None, tokenizer: dict[str, str]) -> np.ndarray:
    """The ids of ``tokenizers`` and the end id.

    The rank file holds the same vocabulary and merges for a faster encoder; tests hold the two against
    each other on every code point.  What it cannot take goes to ``tokenizers``.
    """
    text = text or ""
    try:
        ids = _encoding(tokenizer["ranks"], tokenizer["pattern"]).encode_to_numpy(
            text, disallowed_special=())
    except BaseException as error:  # its pattern engine gives up on some very long runs
        if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        ids = _tokenizer(tokenizer["json"]).encode(text, add_special_tokens=False).ids
    return np.append(np.asarray(ids, "<u4"), np.uint32(END_ID)).astype("<u4")


def pieces(docs: DataFrame, tokenizer: dict[str, str], length: int = LENGTH,
           loss_from: str | None = None) -> DataFrame:
    """One row per piece: whole sequences from a document's start, then what is left.

    ``loss_from`` names a column with the number of tokens at the start of a document that bear no
    loss (an instruction's prompt); without it every token bears loss.
    """
    ship_code(docs.sparkSession)
    df = pack_row(docs)
    loss = field(df, loss_from, "long") if loss_from else F.lit(0).cast("long")
    source = df.select(field(df, "doc_id", "long").alias("doc_id"),
                       field(df, "text", "string").alias("text"),
                       F.coalesce(loss, F.lit(0)).alias("free"))
    names = [f.split()[0] for f in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (text, free) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                ids = token_ids(text.as_py(), tokenizer)
                for at in range(0, len(ids), length):
                    part = ids[at:at + length]
                    rows.append((k, at, len(part), max(0, at + len(part) - max(at, free)),
                                 zlib.crc32(part.tobytes()), len(ids)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())),
                 *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

    return source.mapInArrow(run, _PIECES)


def fill(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The sequence number of each piece (rows of ``demand``), by the dot-product heuristic."""
    demand = demand.astype(float)
    share = demand / limits
    weight = share.mean(axis=0)
    order = np.lexsort((np.arange(len(demand)), -demand[:, 0]))
    score_by = (share * weight)[order]
    need = demand[order]
    out = np.full(len(demand), -1)
    free = np.ones(len(demand), bool)
    used, left = 0, len(demand)
    while left:
        room = limits.astype(float).copy()
        alive = np.flatnonzero(free)
        taken = False
        while len(alive):
            alive = alive[(need[alive] <= room).all(axis=1)]
            if not len(alive):
                break
            best = alive[np.argmax(score_by[alive] @ (room / limits))]
            out[order[best]] = used
            free[best] = False
            room -= need[best]
            alive = alive[alive != best]
            left -= 1
            taken = True
        if not taken:  # a piece over a limit by itself
            best = np.flatnonzero(free)[0]
            out[order[best]] = used
            free[best] = False
            left -= 1
        used += 1
    return out


def pack(docs: DataFrame, tokenizer: dict[str, str], length: int = LENGTH, segments: int = SEGMENTS,
         loss_limit: int | None = None, loss_from: str | None = None,
         group: int = GROUP) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; offsets in a sequence are gapless from 0."""
    limits = np.array([length, segments, loss_limit or length])
    table = settled(pieces(docs, tokenizer, length, loss_from)).withColumn(
        "row", F.monotonically_increasing_id())
    whole = table.where(F.col("length") == length).select(
        *[f.split()[0] for f in _PIECES.split(", ")], (F.col("row") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    rest = table.where(F.col("length") < length)
    groups = max(1, rest.count() // group)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        ones = np.ones(len(pdf))
        pdf["bin"] = fill(np.stack([pdf["length"], ones, pdf["loss"]], axis=1), limits)
        first = pdf.groupby("bin")["row"].transform("min")
        pdf["sequence_id"] = first * 2
        pdf["offset"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns=["bin", "row", "deal"])

    kinds = f"{_PIECES}, sequence_id long, offset long"
    packed = rest.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("deal").applyInPandas(
        place, kinds)
    return whole.unionByName(packed)


def public_tokenizer(name: str = "byte_bpe_50k") -> dict[str, str]:
    """Where the files of an installed public vocabulary are, on every machine alike."""
    import public_tokenizers

    return {"json": public_tokenizers.path(f"{name}.json"),
            "ranks": public_tokenizers.path(f"{name}.tiktoken"), "pattern": public_tokenizers.PATTERN}
