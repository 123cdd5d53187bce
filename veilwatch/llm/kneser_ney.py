"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model.

The model is trained on trusted text (documents labelled as good and not toxic), four fifths of it; the
other fifth sets the thresholds: per language, a quantile of the perplexities of trusted documents the
model has not seen.  A document is kept when its perplexity is at most its language's threshold.

All trusted words are known, and one unknown word stands for all others; no vocabulary is chosen, collected
or broadcast.  Words and bigrams are keyed by 64-bit hashes and live in shards by their leading bits.  A
shard of bigrams adds up what the blocks of trusted text counted and tells each block the sums, and one of
them that the bigram is its to report: that block adds it to the statistics of its context and its word
(``STATS``), which are summed by word in the same shards.  Blocks of documents then ask for the counts of
their distinct bigrams and the statistics of their distinct words, so what is everywhere is one key per
block.  Only the counts of counts, ten numbers, reach the driver.

Requests take more disk than the texts.  So documents are dealt by a hash of id, language and text into a
few slices that ask one after the other, and what a step wrote or shuffled is deleted when the next has its
result.  The table is read once per slice; every row is in exactly one.

Defined results: a null or empty text is its end token alone; repeated rows are judged alike; several
labels of one id count as trusted only if all are; a null doc_id is never trusted; words and bigrams of
equal counts are treated alike whatever their order; a block ends with a whole document, so a very long
text is a block of its own, whose arrays of a few numbers per token must fit a worker; a language without
unseen trusted documents, or a null one, takes the threshold of all languages; without any, everything is
kept; without trusted text every word is unknown; an empty table gives an empty result; extra columns are
not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import dropped, field, id_key, pack_row, settled, ship_code
from veilwatch.llm.lm_score import (
    BLOCK,
    START,
    TOKEN_BYTES,
    _before,
    _by_shard,
    _filled,
    _packed,
    _small,
    _tokens,
    _unpacked,
    _unsmall,
    ngrams,
)
from veilwatch.llm.tokens import (
    END_HASH,
    blocks,
    next_block,
    pack_sorted,
    per_document,
    shard_bits,
    unpack_sorted,
)

QUANTILE = 0.99
#: Added to the logarithm of the quantile, in units of log10 per token.
MARGIN = 0.05
FOLDS = 5
#: Steps of the threshold histogram per unit of log10 perplexity.
GRID = 200
#: Bits of the filter of trusted ids (a megabyte, whatever the number of ids).  It only spares texts the
#: way to the join with the trusted ids, which decides.
FILTER_BITS = 23
#: Documents ask and are scored in so many slices at most, one after the other, and a slice's requests and
#: blocks are deleted before the next: their disk is that of one slice.  Fewer slices for less text.
SLICES = 6
SLICE_BYTES = 32_000_000
#: Per word: distinct contexts before it; as a context: tokens after it, and distinct ones that occur once,
#: twice and more often.
STATS = ("follow", "total", "types1", "types2", "types3")
_DOCS, _WORDS, _PAIRS = 0, 1, 2
_COUNTS = "kind int, part long, block long, a binary, b binary"
_CODED = {"a": "binary", "b": "binary", "c": "binary"}


def _prepared(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents under fixed names, and the ids of the trusted ones (``k1``)."""
    trusted = labels.groupBy(F.col("doc_id").cast("long").alias("k1")).agg(
        F.min((F.coalesce(F.col("quality") == 1, F.lit(False))
               & F.coalesce(F.col("toxic") == 0, F.lit(False))).cast("int")).alias("good")
    ).where((F.col("good") == 1) & F.col("k1").isNotNull()).select("k1")
    df = pack_row(docs)
    doc_id = field(df, "doc_id", "long")
    df = df.select(doc_id.alias("doc_id"), field(df, "lang", "string").alias("lang"),
                   field(df, "text", "string").alias("text"))
    return df, trusted


def _filter_bit(value: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - FILTER_BITS)


def _likely(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The documents but for those whose id sets a bit that no trusted id sets."""
    bit = _filter_bit(F.col("k1"))
    words = trusted.groupBy(F.shiftright(bit, 5).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit.bitwiseAND(F.lit(31))).cast("int")))
        .alias("bits")).collect()  # at most 2 ** (FILTER_BITS - 5) rows
    table = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    for w, bits in words:
        table[w] = bits
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("bit")).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((own[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))

    return docs.select("doc_id", "text", _filter_bit(F.col("doc_id")).alias("bit")).mapInArrow(
        run, "doc_id long, text string, bit long").drop("bit")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    types = [pa.list_(kinds[t[6:-1]]) if t.startswith("array") else kinds[t] for t in types]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def _blocks(source: DataFrame, carried: dict[str, str]) -> DataFrame:
    """Blocks of documents as numbers of their distinct words, with lists of the ``carried`` columns."""
    schema = ", ".join(["block long", *(f"{c} array<{t}>" for c, t in carried.items()),
                        *(f"{c} {t}" for c, t in _CODED.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count()
        for batch in _filled(batches, BLOCK * TOKEN_BYTES):
            own = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in carried]
            for part, words in blocks(batch, "text", BLOCK):
                yield _batch([(next_block(number), *(x[part] for x in own),
                               *_packed(words.hashes, words.ids, words.lens))], schema)

    return source.select("text", *carried).mapInArrow(run, schema)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, tokens, first tokens and word hashes of each block."""
    for batch in batches:
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            hashes, ids, lens = _unpacked(row["a"], row["b"], row["c"])
            yield (row["block"], *_tokens(hashes, ids, lens), hashes)


def _vocabulary(hashes: np.ndarray) -> np.ndarray:
    """All tokens a block may hold, and the start, from its distinct words."""
    return np.append(hashes, [END_HASH, START])


def _counted(training: DataFrame, bits: int) -> DataFrame:
    """Distinct bigrams of every block of training text by shard, with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, tokens, first, _ in _coded(batches):
            keys, n = np.unique(ngrams(tokens, first, 2)[1], return_counts=True)
            yield _batch([(_PAIRS, shard, block, pack_sorted(keys[k]), _small(n[k]))
                          for shard, k in _by_shard(keys, bits)], _COUNTS)

    return training.select("block", *_CODED).mapInArrow(run, _COUNTS)


def _pairs(counted: DataFrame) -> DataFrame:
    """Per shard its bigrams and their corpus counts (block -1), and per block that sent some twice the
    count, plus one where the block is the first to have the bigram."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        sent = [unpack_sorted(a) for a in pdf["a"]]
        keys, at, inverse = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([_unsmall(b) for b in pdf["b"]]), len(keys)).astype(np.uint64)
        told = 2 * n[inverse]
        told[at] += np.uint64(1)
        part = pdf["part"].iloc[0]
        cuts = np.cumsum([len(x) for x in sent])[:-1]
        rows = [(_PAIRS, part, -1, pack_sorted(keys), _small(n))]
        rows += [(_PAIRS, part, b, None, _small(t)) for b, t in zip(pdf["block"], np.split(told, cuts))]
        return pd.DataFrame(rows, columns=["kind", "part", "block", "a", "b"])

    return counted.groupBy("part").applyInPandas(add, _COUNTS)


def _words(training: DataFrame, pairs: DataFrame, bits: int) -> DataFrame:
    """Per shard its words and their ``STATS`` (block -1)."""
    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf[pdf["kind"] == _DOCS].iloc[0]
        told = dict(zip(pdf["part"], pdf["b"]))
        tokens, first = _tokens(*_unpacked(row["a"], row["b"], row["c"]))
        keys, at = np.unique(ngrams(tokens, first, 2)[1], return_index=True)
        n = np.concatenate([_unsmall(told[shard]) for shard, _ in _by_shard(keys, bits)]).astype(np.int64)
        at, n = at[n % 2 == 1], n[n % 2 == 1] // 2
        context, word = _before(tokens, first, START)[at], tokens[at]
        hashes, place = np.unique(np.concatenate([word, context]), return_inverse=True)
        word, context, size = place[:len(at)], place[len(at):], len(hashes)
        stats = [np.bincount(word, minlength=size), np.bincount(context, n, size)]
        stats += [np.bincount(context[some], minlength=size) for some in (n == 1, n == 2, n >= 3)]
        stats = np.stack(stats).astype(np.uint64)
        return pd.DataFrame([(_WORDS, shard, -1, pack_sorted(hashes[k]), _small(stats[:, k].ravel()))
                             for shard, k in _by_shard(hashes, bits)], columns=["kind", "part", "block", "a", "b"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, inverse = np.unique(np.concatenate([unpack_sorted(a) for a in pdf["a"]]), return_inverse=True)
        sums = np.concatenate([_unsmall(b).reshape(len(STATS), -1) for b in pdf["b"]], axis=1)
        whole = np.stack([np.bincount(inverse, x, len(keys)) for x in sums]).astype(np.uint64)
        return pd.DataFrame([(_WORDS, pdf["part"].iloc[0], -1, pack_sorted(keys), _small(whole.ravel()))],
                            columns=["kind", "part", "block", "a", "b"])

    texts = training.withColumns({"kind": F.lit(_DOCS), "part": F.lit(-1).cast("long")})
    told = pairs.where("block >= 0").withColumn("c", F.lit(None).cast("binary"))
    return texts.unionByName(told).groupBy("block").applyInPandas(own, _COUNTS).groupBy("part").applyInPandas(
        add, _COUNTS)


def _network(pairs: DataFrame, words: DataFrame) -> KneserNey:
    """The discounts, from how many bigrams and words have each small count."""
    names = [f"s{k}" for k in range(1, 5)] + [f"f{k}" for k in range(1, 5)] + ["known", "whole"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(names), np.int64)
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = _unsmall(blob)
                n = n if kind == _PAIRS else n.reshape(len(STATS), -1)[0]
                few = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5]
                out[:4] += few if kind == _PAIRS else 0
                if kind == _WORDS:
                    out[4:8] += few
                    out[8:] += [int((n > 0).sum()), int(n.sum())]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=names)

    rows = pairs.where("block < 0").unionByName(words).select("kind", "b")
    sums = rows.mapInArrow(each, ", ".join(f"{n} long" for n in names)).agg(*[F.sum(n) for n in names]).first()
    sums = [int(x or 0) for x in sums]
    return KneserNey(sums[:4], sums[4:8], *sums[8:])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more; half a count where the count-of-counts are too few."""
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *np.clip(d, [0.01, 0.01, 0.01], [0.99, 1.99, 2.99])])


class KneserNey:
    """What every task needs besides counts: the discounts of both orders and two sums."""

    def __init__(self, seen: list[int], follow_seen: list[int], known: int, whole: int):
        self.d, self.low = discounts(*seen), discounts(*follow_seen)
        self.known, self.whole, self.few = known, whole, follow_seen[:2]

    def logs(self, counts: np.ndarray, context: np.ndarray, follow: np.ndarray) -> np.ndarray:
        """log10 P(word | word before) from the bigrams' counts, the ``STATS`` of the contexts and the
        numbers of distinct contexts before the words."""
        total = np.maximum(context[1], 1)
        gamma = np.where(context[1] > 0, (self.d[1:, None] * context[2:]).sum(axis=0) / total, 1.0)
        high = np.maximum(counts - self.d[np.minimum(counts, 3).astype(int)], 0) / total
        return np.log10(high + gamma * self.lower(follow))

    def lower(self, follow: np.ndarray) -> np.ndarray:
        """The lower order: continuation counts, discounted down to an even spread over the known words and
        one unknown word."""
        if not self.whole:
            return np.full(len(follow), 1 / (self.known + 1))
        own = np.maximum(follow - self.low[np.minimum(follow, 3).astype(int)], 0) / self.whole
        return own + self.spared / (self.known + 1)

    @property
    def spared(self) -> float:
        """The share of the lower order that its discounts leave."""
        ones, twos = self.few
        return float(self.low[1] * ones + self.low[2] * twos + self.low[3] * (self.known - ones - twos)) / self.whole


def _asked(texts: DataFrame, bits: int) -> DataFrame:
    """The distinct words and bigrams of every block by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, tokens, first, hashes in _coded(batches):
            words = np.unique(_vocabulary(hashes))
            for kind, keys in ((_WORDS, words), (_PAIRS, np.unique(ngrams(tokens, first, 2)[1]))):
                yield _batch([(kind, shard, block, pack_sorted(keys[k]), None)
                              for shard, k in _by_shard(keys, bits)], _COUNTS)

    return texts.select("block", *_CODED).mapInArrow(run, _COUNTS).drop("b")


def _told(asked: DataFrame, model: DataFrame) -> DataFrame:
    """Per block and shard what was asked for: the counts of its bigrams, the ``STATS`` of its words."""
    def answer(key: tuple, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        known = unpack_sorted(own["a"].iloc[0]) if len(own) else np.empty(0, np.uint64)
        values = _unsmall(own["b"].iloc[0]) if len(own) else np.empty(0, np.uint64)
        values = values.reshape(len(STATS) if key[0] == _WORDS else 1, -1)
        rows = []
        for block, a in zip(asked["block"], asked["a"]):
            keys = unpack_sorted(a)
            found = np.zeros((len(values), len(keys)), np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                there = known[at] == keys
                found[:, there] = values[:, at[there]]
            rows.append((*key, block, _small(found.ravel())))
        return pd.DataFrame(rows, columns=["kind", "part", "block", "b"])

    return asked.groupBy("kind", "part").cogroup(model.groupBy("kind", "part")).applyInPandas(
        answer, "kind int, part long, block long, b binary")


def _scored(source: DataFrame, model: DataFrame, network: KneserNey, bits: int) -> DataFrame:
    """One row per document of ``source``, written: ``doc_id``, ``lang``, ``n_tokens``, ``log_perplexity``."""
    texts = settled(_blocks(source, {"doc_id": "long", "lang": "string"}))
    told = _told(_asked(texts, bits), model)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf[pdf["kind"] == _DOCS].iloc[0]
        blobs = {(k, p): b for k, p, b in zip(pdf["kind"], pdf["part"], pdf["b"])}
        hashes, ids, lens = _unpacked(row["a"], row["b"], row["c"])
        tokens, first = _tokens(hashes, ids, lens)

        def values(kind: int, keys: np.ndarray, height: int) -> np.ndarray:
            found = [_unsmall(blobs[kind, shard]).reshape(height, -1) for shard, _ in _by_shard(keys, bits)]
            return np.concatenate(found, axis=1).astype(np.int64)

        # a bigram's probability is worked out once, at the first token that has it
        keys, at, pair = np.unique(ngrams(tokens, first, 2)[1], return_index=True, return_inverse=True)
        counts = values(_PAIRS, keys, 1)[0]
        keys, place = np.unique(_vocabulary(hashes), return_inverse=True)
        stats = values(_WORDS, keys, len(STATS))
        word, _ = _tokens(place[:-2], ids, lens, place[-2])
        before = _before(word, first, place[-1])
        logs = network.logs(counts, stats[:, before[at]], stats[0, word[at]])
        sums = per_document(logs[pair], lens + 1)
        return pd.DataFrame({"doc_id": pd.array(row["doc_id"], dtype="Int64"), "lang": row["lang"],
                             "n_tokens": lens + 1, "log_perplexity": -sums / (lens + 1)})

    empty = {c: F.lit(None).cast(texts.schema[c].dataType) for c in ("doc_id", "lang", "a", "c")}
    both = texts.withColumns({"kind": F.lit(_DOCS), "part": F.lit(-1).cast("long")}).unionByName(
        told.withColumns(empty))
    scored = settled(both.groupBy("block").applyInPandas(
        total, "doc_id long, lang string, n_tokens long, log_perplexity double"), lean=True)
    dropped(texts)
    return scored


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``lang``, ``n_tokens``, ``log_perplexity``, ``check``."""
    ship_code(docs.sparkSession)
    source, trusted = _prepared(docs, labels)
    fold = F.floor(F.crc32(F.col("doc_id").cast("string")) / FOLDS) % FOLDS == 0
    trusted = settled(trusted)
    likely = _likely(source.where(~fold), trusted)
    training = settled(_blocks(likely.join(  # the same join at every size
        trusted.hint("merge"), likely["doc_id"] == trusted["k1"], "left_semi"), {}), lean=True)
    size = int(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = shard_bits(size // TOKEN_BYTES)
    pairs = settled(_pairs(_counted(training, bits)), lean=True)
    words = settled(_words(training, pairs, bits), lean=True)
    dropped(training)
    network = _network(pairs, words)
    model = pairs.where("block < 0").unionByName(words).drop("block")
    slices = min(SLICES, size // SLICE_BYTES + 1)
    own = F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(slices))
    scored = reduce(DataFrame.unionByName, [
        _scored(source.where(own == k), model, network, bits) for k in range(slices)])
    dropped(pairs, words)
    check = trusted.select(F.col("k1"), F.lit(True).alias("check"))
    return scored.withColumn("k1", id_key(F.col("doc_id"))).join(check, "k1", "left").withColumn(
        "check", F.coalesce("check", F.lit(False)) & F.coalesce(fold, F.lit(False)))


def thresholds(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Per language, and once for all (``every``), the largest log10 perplexity that is kept."""
    cells = scored.where("check").withColumn(
        "cell", F.floor(F.col("log_perplexity") * GRID).cast("long"))
    both = cells.select("cell", F.explode(F.array(
        F.struct(F.lit(False).alias("every"), F.col("lang").alias("of")),
        F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("of")))).alias("x"))
    n = both.groupBy("x.every", "x.of", "cell").agg(F.count(F.lit(1)).alias("c"))
    n = n.withColumn("upto", F.expr("sum(c) over (partition by every, of order by cell)"))
    n = n.withColumn("whole", F.expr("sum(c) over (partition by every, of)"))
    return n.where(F.col("upto") >= quantile * F.col("whole")).groupBy("every", "of").agg(
        (F.min("cell") / GRID + (1 / GRID + margin)).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE,
             margin: float = MARGIN) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``log_perplexity``, ``threshold``, ``kept``."""
    scored = settled(perplexities(docs, labels))
    limits = settled(thresholds(scored, quantile, margin))
    whole = limits.where("every").select("threshold").first()
    whole = F.lit(whole[0] if whole else None).cast("double")
    per = limits.where("not every and of is not null").select(
        F.col("of").alias("lang"), F.col("threshold").alias("own"))
    out = scored.join(per, "lang", "left").withColumn("threshold", F.coalesce("own", whole))
    return out.select("doc_id", "lang", "n_tokens", "log_perplexity", "threshold", F.coalesce(
        F.col("log_perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
