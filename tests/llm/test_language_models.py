import math
import threading
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import edge_docs, empty_docs
from veilwatch.llm import common
from veilwatch.llm import kneser_ney as K
from veilwatch.llm import lm_score as L
from veilwatch.llm import tokens as T

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for values in ([], [0], [5, 0, 255, 256, 2 ** 63], rng.integers(0, 2 ** 40, 1000)):
        values = np.array(values, np.uint64)
        assert (T.unpack_planes(T.pack_planes(values)) == values).all()
        keys = np.unique(values)
        assert (T.unpack_sorted(T.pack_sorted(keys)) == keys).all()


def test_words():
    words = T.Words.of([b"The the  tHE\x0bend", None, b"", "É é".encode()])
    assert words.lens.tolist() == [4, 0, 0, 2] and len(words.hashes) == 4
    assert words.ids[:3].tolist() == [words.ids[0]] * 3


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def brute_base(rows):
    held = [zlib.crc32(str(k).encode()) % 5 == 1 if k is not None else False for k, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    return [(k, h, len(tokens_of(t)), sum(w in counts for w in tokens_of(t)), n, sum(
        math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens_of(t)))
        for (k, t), h in zip(rows, held)]


def key(row):
    return (row[0] is not None, row[0] or 0, row[2])


def test_base_equals_brute_force(spark):
    docs = edge_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted(brute_base(rows), key=key)
    got = sorted([tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
                                       "base_score")) for r in L.score(docs).collect()], key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def brute_scores(rows, order, rounds=L.ROUNDS):
    """Deleted interpolation by plain dictionaries of word tuples, without a grid."""
    def crc(k):
        return None if k is None else zlib.crc32(str(k).encode())

    held = [crc(k) is not None and crc(k) % 5 == 1 for k, _ in rows]
    fold = [not h and crc(k) is not None and crc(k) // 5 % 5 == 0 for (k, _), h in zip(rows, held)]

    def grams(text):
        words = [None] * (order - 1) + tokens_of(text)
        return [tuple(words[at - order + 1:at + 1]) for at in range(order - 1, len(words))]

    def model(some):
        counts, contexts = Counter(), Counter()
        for (_, t), use in zip(rows, some):
            for g in grams(t) if use else ():
                for k in range(1, order + 1):
                    counts[g[-k:]] += 1
                    contexts[g[-k:-1]] += 1
        return counts, contexts

    def parts(g, counts, contexts):
        return [counts[g[-k:]] / max(contexts[g[-k:-1]], 1) for k in range(order, 0, -1)], contexts[g[:-1]]

    whole = model([not h for h in held])
    v = sum(len(g) == 1 for g in whole[0])
    spread = 1 / (v + 1)
    kept = model([not h and not f for h, f in zip(held, fold)])
    by = {}
    for (_, t), f in zip(rows, fold):
        for g in grams(t) if f else ():
            p, context = parts(g, *kept)
            by.setdefault(int(math.log2(context + 1)), []).append([*p, spread])
    lam = {}
    for bucket in range(64):
        if bucket not in by:
            first = [0.0, *[1 / order] * order] if bucket == 0 else [1 / (order + 1)] * (order + 1)
            lam[bucket] = lam[bucket - 1] if bucket > 1 else np.array(first)
            continue
        p = np.array(by[bucket]).T
        x = np.full(order + 1, 1 / (order + 1)) if bucket else np.array([0.0, *[1 / order] * order])
        for _ in range(rounds):
            m = x[:, None] * p
            x = (m / m.sum(axis=0)).mean(axis=1)
        x = np.maximum(x, [1e-9 if bucket else 0.0, *[1e-9] * (order - 1), 1e-6])
        lam[bucket] = x / x.sum()
    out = []
    for k, t in rows:
        logs = 0.0
        for g in grams(t):
            p, context = parts(g, *whole)
            logs += math.log10(lam[int(math.log2(context + 1))] @ np.array([*p, spread]))
        out.append((k, logs))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_brute_force(spark, monkeypatch, order):
    """Ties, repeated rows and several blocks and shards; only the histogram's grid lies between."""
    monkeypatch.setattr(L, "GRID", 512)
    monkeypatch.setattr(L, "BLOCK", 3000)
    monkeypatch.setattr(L, "shard_bits", lambda n: 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(
        edge_docs(spark).where("length(text) < 2000 or text is null").select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(brute_scores(rows, order), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(((r["doc_id"], r["score"]) for r in L.score(docs.repartition(3), order).collect()),
                 key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=2e-3)


def test_no_cliff_in_the_number_of_words(spark):
    """Every document occurs ten times; more distinct words than any table of words would hold change little."""
    def loss(words):
        per = words // 100
        one = spark.range(1000).selectExpr("id AS doc_id", f"array_join(transform(sequence(0, {per} - 1), "
                                           f"k -> concat('w', (id % 100) * {per} + k)), ' ') AS text")
        row = L.score(one).where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()
        return row[0]

    few, many = loss(20_000), loss(80_000)
    assert few > -0.05 and many > few - 0.02


def test_many_shards_and_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r["doc_id"]: r["score"] for r in L.score(docs).collect()}
    monkeypatch.setattr(L, "shard_bits", lambda n: 4)
    monkeypatch.setattr(L, "BLOCK", 2000)
    many = {r["doc_id"]: r["score"] for r in L.score(docs.repartition(5, "doc_id")).collect()}
    assert many == pytest.approx(one, rel=1e-9)


def test_better_than_base_on_held_out_text(spark):
    rows = L.score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").toPandas()
    assert rows["score"].sum() > rows["base_score"].sum()
    assert (rows["score"] > rows["base_score"]).mean() > 0.7


def test_expectation_maximisation_finds_the_best_mixture():
    rng = np.random.default_rng(2)
    cells = pd.DataFrame({"bucket": 3, "c2": rng.integers(-60, 0, 200), "c1": rng.integers(-90, -20, 200),
                          "n": rng.integers(1, 50, 200)})
    lam = L.learned_weights(cells, 1e-4, rounds=500)[3]
    p = np.stack([np.exp2(cells["c2"] / L.GRID), np.exp2(cells["c1"] / L.GRID), np.full(200, 1e-4)])

    def loss(x):
        return -(np.log(x @ p) * cells["n"]).sum()

    assert lam.sum() == pytest.approx(1)
    for other in rng.dirichlet([1, 1, 1], 500):
        assert loss(lam) <= loss(other) + 1e-6


def test_mixture_sums_to_one():
    lam = L.learned_weights(pd.DataFrame({"bucket": [2], "c2": [-8], "c1": [-16], "n": [4]}), 0.01)
    assert lam.sum(axis=1) == pytest.approx(np.ones(len(lam)))
    assert lam[0, 0] == 0  # a context never seen says nothing


class Plain:
    """Modified Kneser-Ney with dictionaries."""

    def __init__(self, texts):
        self.pairs = Counter(g for t in texts for g in self.grams(t))
        self.follow = Counter(b for _, b in self.pairs)
        self.by = {}
        for (a, _), n in self.pairs.items():
            self.by.setdefault(a, []).append(n)
        self.d, self.low = (K.discounts(*(sum(n == k for n in c.values()) for k in (1, 2, 3, 4)))
                            for c in (self.pairs, self.follow))
        self.spared = sum(self.low[min(f, 3)] for f in self.follow.values())
        self.left = {a: (sum(self.d[min(k, 3)] for k in after), sum(after)) for a, after in self.by.items()}

    @staticmethod
    def grams(text):
        tokens = ["<s>", *tokens_of(text)]
        return list(zip(tokens, tokens[1:]))

    def p(self, a, b):
        size = len(self.follow) + 1
        lower = 1 / size
        if self.follow:
            f = self.follow.get(b, 0)
            lower = (max(f - self.low[min(f, 3)], 0) + self.spared / size) / len(self.pairs)
        if a not in self.by:
            return lower
        n, (left, total) = self.pairs.get((a, b), 0), self.left[a]
        return (max(n - self.d[min(n, 3)], 0) + left * lower) / total

    def perplexity(self, text):
        grams = self.grams(text)
        return -sum(math.log10(self.p(*g)) for g in grams) / len(grams)


def trained_on(rows, labels):
    good = {}
    for k, quality, toxic in labels:
        good[k] = good.get(k, True) and quality == 1 and toxic == 0
    return [t for k, t in rows if k is not None and good.get(k) and zlib.crc32(str(k).encode()) // 5 % 5 != 0]


@pytest.mark.parametrize("bits", [0, 3])
def test_perplexities_equal_brute_force(spark, monkeypatch, bits):
    """Ties, repeated rows, unknown words, many more words than a block holds, several blocks and shards."""
    monkeypatch.setattr(K, "BLOCK", 3000)
    monkeypatch.setattr(K, "shard_bits", lambda n: bits)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(
        edge_docs(spark).where("length(text) < 2000 or text is null").select("doc_id", "text", "lang"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 150)] + [(7, 0, 0), (None, 1, 0), (8, 1, None)], LABELS)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = Plain(trained_on(rows, [tuple(r) for r in labels.collect()]))
    assert len(plain.follow) > 5000 and 1 in plain.follow.values()
    want = sorted((k is not None, k or 0, plain.perplexity(t)) for k, t in rows)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["log_perplexity"])
                 for r in K.perplexities(docs.repartition(3), labels).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)


def test_no_class_of_rare_words(spark):
    """70,000 words that occur once each are known; as many words that never occur are not."""
    text = "array_join(transform(sequence(0, 699), k -> concat('{}', id * 700 + k)), ' ') AS text"
    seen = spark.range(100).selectExpr("id AS doc_id", text.format("w"), "'en' AS lang")
    other = spark.range(100).selectExpr("id + 1000 AS doc_id", text.format("z"), "'en' AS lang")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(100)], LABELS)
    rows = K.perplexities(seen.unionByName(other), labels).groupBy(F.col("doc_id") >= 1000, "check").agg(
        F.avg("log_perplexity")).collect()
    mean = {(new, check): p for new, check, p in rows}
    assert mean[False, False] < 1 and mean[True, False] > 4 and mean[False, True] > 4


def test_probabilities_sum_to_one():
    texts = ["a b c a b d", "a b c", "x y a b", "c c c d rare"]
    plain = Plain(texts)
    net = K.KneserNey(*([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)] for c in (plain.pairs, plain.follow)),
                      len(plain.follow), len(plain.pairs))
    for before in ["<s>", *plain.follow, "never"]:
        after = plain.by.get(before, [])
        context = np.array([plain.follow.get(before, 0), sum(after), *(sum(n == k for n in after) for k in (1, 2)),
                            sum(n >= 3 for n in after)])[:, None]
        words = [*plain.follow, "unknown"]
        counts = np.array([plain.pairs.get((before, w), 0) for w in words])
        p = 10 ** net.logs(counts, np.repeat(context, len(words), axis=1),
                           np.array([plain.follow.get(w, 0) for w in words]))
        assert p.sum() == pytest.approx(1)
        assert p.tolist() == pytest.approx([plain.p(before, w) for w in words])


def test_discounts():
    d = K.discounts(100, 40, 20, 10)
    y = 100 / 180
    assert d.tolist() == pytest.approx([0, 1 - 2 * y * .4, 2 - 3 * y * .5, 3 - 4 * y * .5])


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.floor(F.crc32(F.col("doc_id").cast("string")) / K.FOLDS) % K.FOLDS == 0
    rows = K.classify(docs, labels).join(labels, "doc_id").where(fold).select("kept", "quality").collect()
    good = np.mean([r["kept"] for r in rows if r["quality"] == 1])
    bad = np.mean([r["kept"] for r in rows if r["quality"] == 0])
    assert len(rows) > 200 and good > 0.97 and bad < 0.4


def test_quality_edge_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(100, 1, 0), (101, 1, 0), (102, 1, 0), (103, 1, 0), (103, 0, 0),
                                    (104, 1, None), (None, 1, 0), (4, 1, 0)], LABELS)
    rows = K.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert len({r["log_perplexity"] for r in rows if r["doc_id"] == 4}) == 1
    none = K.classify(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == docs.count() and all(r["kept"] for r in none)


def test_slices_give_the_same(spark, monkeypatch):
    """Every row is in one slice, repeated and null ids as well."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(edge_docs(spark).select("doc_id", "text", "lang"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 150)], LABELS)

    def rows():
        return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["lang"] or "", r["check"], r["n_tokens"],
                       r["log_perplexity"]) for r in K.perplexities(docs, labels).collect())

    one = rows()
    monkeypatch.setattr(K, "SLICE_BYTES", 1000)
    many = rows()
    assert [r[:5] for r in many] == [r[:5] for r in one] and len(one) == docs.count()
    assert [r[5] for r in many] == pytest.approx([r[5] for r in one], rel=1e-9)


class Disk:
    """The most bytes that new files of the shared folder and of shuffles had while it was open."""

    def __init__(self, spark):
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        self.folders = [Path(common.shared_folder(spark).removeprefix("file://")), *(Path(f.getPath()) for f in local)]
        self.old, self.most, self.over = set(self.files()), 0, threading.Event()

    def files(self):
        out = {}
        for folder in self.folders:
            for file in folder.rglob("*"):
                try:
                    if file.is_file() and not file.name.startswith("broadcast"):
                        out[file] = file.stat().st_size
                except OSError:  # it went meanwhile
                    pass
        return out

    def watch(self):
        while not self.over.wait(0.1):
            self.most = max(self.most, sum(n for f, n in self.files().items() if f not in self.old))

    def __enter__(self):
        self.watching = threading.Thread(target=self.watch)
        self.watching.start()
        return self

    def __exit__(self, *_):
        self.over.set()
        self.watching.join()


def test_disk_of_the_classifier(spark, monkeypatch):
    """Requests and blocks of one slice at a time, and nothing of earlier steps."""
    monkeypatch.setattr(K, "SLICE_BYTES", 1_000_000)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    size = sum(Path(f.removeprefix("file://")).stat().st_size for f in docs.inputFiles())
    with Disk(spark) as disk:
        assert K.classify(docs, labels).count() == docs.count()
    print(f"{disk.most / size:.2f} x input")
    assert disk.most < 2 * size


def test_shuffle_files_and_tables_go_early(spark):
    df = spark.range(200_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("id").alias("n"))
    before = spark.conf.get(common.SHUFFLE_CLEANUP, "false")
    table = common.settled(df, lean=True)
    assert spark.conf.get(common.SHUFFLE_CLEANUP, "false") == before
    assert sum(r["n"] for r in table.collect()) == 200_000
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.is_dir()
    common.dropped(table)
    assert not folder.exists()


def test_thresholds_per_language(spark):
    rows = [(lang, True, float(k + at)) for lang, at in (("a", 0), ("b", 5)) for k in range(100)]
    df = spark.createDataFrame(rows, "lang string, check boolean, log_perplexity double")
    got = {(r["every"], r["of"]): r["threshold"] for r in K.thresholds(df, 0.9, 0.0).collect()}
    assert got[False, "a"] == pytest.approx(89, abs=0.02) and got[False, "b"] == pytest.approx(94, abs=0.02)


def test_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert L.score(empty_docs(spark)).count() == 0
    assert K.classify(empty_docs(spark), labels).count() == 0
