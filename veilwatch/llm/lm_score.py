"""LM scoring by deleted interpolation.

A text's log10 probability under a word n-gram model: maximum-likelihood estimates of a token given the
tokens before it, of every order up to ``order``, and an even spread over all known words and one unknown
one are mixed with weights that depend on how often the longest context was seen (buckets by powers of
two).  The weights are learned by expectation-maximisation on held-out counts: a fifth of the training
documents is deleted from the estimates and its tokens' counts say which mixture predicts them best.
Scores then use all training counts.

N-grams are keyed by 64-bit hashes of their words, of all words alike: no vocabulary is chosen, collected
or broadcast.  A block of documents asks for the counts of its distinct n-grams by the sharded join of
``tokens``; counts cover every training document and scores every token.

Defined results: a null or empty text is its end token alone; repeated rows count and are scored each;
a null doc_id is trained on (its remainder is not 1); without training tokens every word is unseen; words
of equal counts are treated alike whatever their order; a block ends with a whole document, so a very long
text is a block of its own, whose arrays of a few numbers per token must fit a worker; an empty table
gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import field, pack_row, settled, ship_code
from veilwatch.llm.tokens import (
    END_HASH,
    blocks,
    next_block,
    pack_planes,
    pack_sorted,
    per_document,
    shard_bits,
    unpack_planes,
    unpack_sorted,
)

FOLDS = 5
ROUNDS = 60
#: Words of the longest n-gram.
ORDER = 2
#: Steps of the held-out histogram per doubling of a probability, for two orders; more orders take a quarter.
GRID = 8
#: Tokens of a block: its arrays of 64-bit numbers must fit a worker several times over.
BLOCK = 1_000_000
#: Bytes a token takes about, for the number of shards.
TOKEN_BYTES = 6
START = np.uint64(0x5851F42D4C957F2D)
_ZERO = -(1 << 20)
_DOCS = 0
_BLOCKS = ("block long, doc_ids array<long>, held array<boolean>, main array<boolean>, fold array<boolean>, "
           "a binary, b binary, c binary")
_REQUESTS = "kind int, part long, block long, a binary, b binary, c binary"


def _prepared(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``held`` (test) and the training weights ``main`` and ``fold``."""
    df = pack_row(docs)
    df = df.select(field(df, "doc_id", "long").alias("doc_id"), field(df, "text", "string").alias("text"))
    crc = F.crc32(F.col("doc_id").cast("string"))
    held = F.coalesce(crc % FOLDS == 1, F.lit(False))
    fold = F.coalesce(F.floor(crc / FOLDS) % FOLDS == 0, F.lit(False))
    return df.withColumns({"held": held, "main": ~held & ~fold, "fold": ~held & fold})


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an n-gram from that of its beginning and its last word."""
    x = (context ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _by_shard(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The slices of sorted keys per shard, which is their leading bits: what is left of a key is short."""
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else [0]
    for shard, (a, b) in enumerate(zip(edges, [*edges[1:], len(keys)])):
        if a < b:
            yield shard, slice(a, b)


def _small(values: np.ndarray) -> bytes:
    """Numbers of few different values."""
    return zlib.compress(pack_planes(values), 1)


def _unsmall(blob: bytes) -> np.ndarray:
    return unpack_planes(zlib.decompress(blob))


def _tokens(hashes: np.ndarray, ids: np.ndarray, lens: np.ndarray, end=END_HASH) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, an end after every document, and which tokens are a document's first."""
    ends = np.cumsum(lens + 1) - 1
    out = np.full(int((lens + 1).sum()), end)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = hashes[ids]
    first = np.zeros(len(out), bool)
    first[ends - lens] = True
    return out, first


def _before(values: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The value of the token before, ``start`` at a document's first token."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = start
    return out


def ngrams(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order the key of the n-gram that ends at each token."""
    keys = [tokens]
    for _ in range(1, order):
        keys.append(_mixed(_before(keys[-1], first, START), tokens))
    return keys


def _packed(hashes: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return _small(ids), _small(lens), hashes.tobytes()


def _unpacked(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a block, their numbers in its documents, the documents' lengths."""
    return np.frombuffer(c, np.uint64), _unsmall(a).astype(np.int64), _unsmall(b).astype(np.int64)


def _filled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes of text, or of one longer batch."""
    waiting, held = [], 0
    for batch in batches:
        waiting.append(batch)
        held += batch.nbytes
        if held >= size:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, held = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _blocks(source: DataFrame) -> DataFrame:
    """Blocks of documents as numbers of their distinct words."""
    schema = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.bool_())] * 3, *[pa.binary()] * 3]
    names = [f.split()[0] for f in _BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count()
        for batch in _filled(batches, BLOCK * TOKEN_BYTES):
            docs = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in batch.schema.names
                    if n != "text"}
            for part, words in blocks(batch, "text", BLOCK):
                row = (next_block(number), docs["doc_id"][part], docs["held"][part], docs["main"][part],
                       docs["fold"][part], *_packed(words.hashes, words.ids, words.lens))
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, schema)], names=names)

    return source.mapInArrow(run, _BLOCKS)


def _requests(docs: DataFrame, bits: int, order: int) -> DataFrame:
    """A block's distinct n-grams by order and shard, with how often they occur in its training documents."""
    schema = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
    names = [f.split()[0] for f in _REQUESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                hashes, ids, lens = _unpacked(row["a"], row["b"], row["c"])
                tokens, first = _tokens(hashes, ids, lens)
                weights = [np.repeat(np.array(row[w], np.int64), lens + 1) for w in ("main", "fold")]
                for kind, keys in enumerate(ngrams(tokens, first, order), 1):
                    distinct, inverse = np.unique(keys, return_inverse=True)
                    sums = [np.bincount(inverse, w, len(distinct)) for w in weights]
                    rows = [(kind, shard, row["block"], pack_sorted(distinct[k]), _small(sums[0][k]),
                             _small(sums[1][k])) for shard, k in _by_shard(distinct, bits)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), schema)], names=names)

    return docs.select("block", "main", "fold", "a", "b", "c").mapInArrow(run, _REQUESTS)


def _held_out(docs: DataFrame) -> DataFrame:
    """The deleted training documents of every block that has some, in the form of its answers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                some = np.array(row["fold"], bool)
                if not some.any():
                    continue
                hashes, ids, lens = _unpacked(row["a"], row["b"], row["c"])
                used, numbers = np.unique(ids[np.repeat(some, lens)], return_inverse=True)
                own = (_DOCS, -1, row["block"], *_packed(hashes[used], numbers, lens[some]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], k) for c, k in zip(own, [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3])],
                    names=[f.split()[0] for f in _REQUESTS.split(", ")])

    return docs.select("block", "fold", "a", "b", "c").mapInArrow(run, _REQUESTS)


def _answers(requests: DataFrame) -> DataFrame:
    """Per block and shard the corpus counts of its keys; kind negated: the undeleted counts of the keys its
    held-out documents have; at block -1 the shard's sums and number of keys."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        asked = [unpack_sorted(a) for a in pdf["a"]]
        keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        held = np.concatenate([_unsmall(c) for c in pdf["c"]])
        main = np.bincount(inverse, np.concatenate([_unsmall(b) for b in pdf["b"]]), len(keys))
        total = main + np.bincount(inverse, held, len(keys))
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        kind, part = pdf["kind"].iloc[0], pdf["part"].iloc[0]
        rows = [(kind, part, b, _small(t)) for b, t in zip(pdf["block"], np.split(total[inverse], cuts))]
        rows += [(-kind, part, b, _small(m[h > 0])) for b, m, h in zip(
            pdf["block"], np.split(main[inverse], cuts), np.split(held, cuts)) if (h > 0).any()]
        if kind == 1:
            rows.append((kind, part, -1, _small(np.array([main.sum(), total.sum(), (total > 0).sum()]))))
        return pd.DataFrame(rows, columns=["kind", "part", "block", "a"])

    return requests.groupBy("kind", "part").applyInPandas(
        add, "kind int, part long, block long, a binary")


def _sums(answers: DataFrame) -> tuple[int, int, int]:
    """Training tokens without and with the deleted ones, and distinct training tokens."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [_unsmall(a).astype(np.int64) for a in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(sums).reshape(-1, 3).T],
                                             names=["main", "total", "known"])

    row = answers.where("block = -1").select("a").mapInArrow(each, "main long, total long, known long").agg(
        F.sum("main"), F.sum("total"), F.sum("known")).first()
    return tuple(int(x or 0) for x in row)


def _counted(keys: list[np.ndarray], told: dict, bits: int, sign: int) -> list[np.ndarray]:
    """Per order the count of each token's n-gram, from the answers of the shards."""
    out = []
    for kind, own in enumerate(keys, 1):
        distinct, inverse = np.unique(own, return_inverse=True)
        found = np.zeros(len(distinct))
        for shard, k in _by_shard(distinct, bits):
            found[k] = _unsmall(told[sign * kind, shard])
        out.append(found[inverse])
    return out


def _estimates(counts: list[np.ndarray], first: np.ndarray, tokens: int, starts: int) -> tuple[np.ndarray, list]:
    """How often the longest context was seen, and the estimates from the longest order down."""
    contexts = [np.full(len(first), float(tokens))] + [_before(c, first, float(starts)) for c in counts[:-1]]
    return contexts[-1], [c / np.maximum(n, 1) for c, n in zip(counts, contexts)][::-1]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(context, 0) + 1.0)).astype(np.int64)


def _cell(p: np.ndarray, grid: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * grid), _ZERO).astype(np.int64)


def grid_of(order: int) -> int:
    return GRID if order <= 2 else GRID // 4


def _histogram(docs: DataFrame, answers: DataFrame, bits: int, order: int, tokens: int, starts: int) -> pd.DataFrame:
    """The held-out tokens by context bucket and grid cells of the estimates; bounded by the grid."""
    names, grid = [f"c{k}" for k in range(order, 0, -1)], grid_of(order)
    schema = "bucket long, " + ", ".join(f"{n} long" for n in names) + ", n long"

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf[pdf["kind"] == _DOCS].iloc[0]
        own, first = _tokens(*_unpacked(row["a"], row["b"], row["c"]))
        told = {(k, p): a for k, p, a in zip(pdf["kind"], pdf["part"], pdf["a"]) if k < 0}
        counts = _counted(ngrams(own, first, order), told, bits, -1)
        context, p = _estimates(counts, first, tokens, starts)
        at, n = np.unique(np.stack([_bucket(context), *[_cell(x, grid) for x in p]]), axis=1,
                          return_counts=True)
        return pd.DataFrame(dict(zip(["bucket", *names], at)) | {"n": n})

    blank = {c: F.lit(None).cast("binary") for c in ("b", "c")}
    both = _held_out(docs).unionByName(answers.where("kind < 0").withColumns(blank))
    return both.groupBy("block").applyInPandas(cells, schema).groupBy("bucket", *names).agg(
        F.sum("n").alias("n")).toPandas()


def learned_weights(cells: pd.DataFrame, spread: float, rounds: int = ROUNDS, order: int = ORDER) -> np.ndarray:
    """Per bucket the weights of the estimates from the longest order down and of the even spread, by EM on
    held-out counts.

    A bucket without held-out tokens takes the weights of the nearest lower one with some, and a context
    never seen gives nothing to the longest estimate.
    """
    names = [f"c{k}" for k in range(order, 0, -1)]
    unseen = np.array([0.0, *[1 / order] * order])
    even = np.full(order + 1, 1 / (order + 1))
    out = np.tile(unseen, (64, 1))
    for bucket in range(64):
        own = cells[cells["bucket"] == bucket]
        if not len(own):
            if bucket:
                out[bucket] = out[bucket - 1] if bucket > 1 else even
            continue
        p = np.stack([np.where(own[c] == _ZERO, 0.0, np.exp2(own[c].astype(float) / grid_of(order)))
                      for c in names] + [np.full(len(own), spread)])
        n = own["n"].to_numpy(float)
        lam = even if bucket else unseen
        for _ in range(rounds):
            mixed = lam[:, None] * p
            lam = (mixed / mixed.sum(axis=0) * n).sum(axis=1) / n.sum()
        lam = np.maximum(lam, [1e-9 if bucket else 0.0, *[1e-9] * (order - 1), 1e-6])
        out[bucket] = lam / lam.sum()
    return out


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, token counts, ``base_score`` and ``score``."""
    if order < 2:
        raise ValueError("an n-gram model needs an order of two or more")
    ship_code(docs.sparkSession)
    source = _prepared(docs)
    size, main, fold = (int(x or 0) for x in source.agg(
        F.sum(F.octet_length("text")), F.count_if("main"), F.count_if("fold")).first())
    bits = shard_bits(size // TOKEN_BYTES)
    texts = settled(_blocks(source))
    answers = settled(_answers(_requests(texts, bits, order)))
    undeleted, n, v = _sums(answers)
    spread = 1 / (v + 1)
    mixture = learned_weights(_histogram(texts, answers, bits, order, undeleted, main), spread, order=order)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf[pdf["kind"] == _DOCS].iloc[0]
        told = {(k, p): a for k, p, a in zip(pdf["kind"], pdf["part"], pdf["a"]) if k != _DOCS}
        hashes, ids, lens = _unpacked(row["a"], row["b"], row["c"])
        tokens, first = _tokens(hashes, ids, lens)
        counts = _counted(ngrams(tokens, first, order), told, bits, 1)
        context, estimates = _estimates(counts, first, n, main + fold)
        lam = mixture[_bucket(context)]
        logs = np.log10(sum(lam[:, k] * p for k, p in enumerate(estimates)) + lam[:, -1] * spread)
        base = np.log10((counts[0] + 0.5) / (n + 0.5 * (v + 1)))
        sizes = lens + 1
        return pd.DataFrame({
            "doc_id": pd.array(row["doc_ids"], dtype="Int64"), "held_out": row["held"], "n_tokens": sizes,
            "n_known": per_document((counts[0] > 0).astype(float), sizes).round().astype(np.int64),
            "train_tokens": n, "base_score": per_document(base, sizes),
            "score": per_document(logs, sizes)})

    whole = texts.drop("main", "fold").withColumns(
        {"kind": F.lit(_DOCS), "part": F.lit(-1).cast("long")})
    empty = {"doc_ids": F.lit(None).cast("array<long>"), "held": F.lit(None).cast("array<boolean>"),
             "b": F.lit(None).cast("binary"), "c": F.lit(None).cast("binary")}
    both = whole.unionByName(answers.where("block >= 0 and kind > 0").withColumns(empty))
    return both.groupBy("block").applyInPandas(
        total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")
