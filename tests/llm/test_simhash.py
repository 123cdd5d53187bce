import random

import numpy as np
import xxhash

from tests.llm.helpers import edge_docs, edge_rows, empty_docs
from veilwatch.llm import simhash as S
from veilwatch.llm.components import components


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in ["a", "A b", "a b c", "a b c d", "Ünï cödé wörds ÀÉ here", *[r[1] for r in edge_rows()[:7]]]:
        assert S.fingerprint((text or "").encode()) == plain(text)


def test_only_a_to_z_lose_their_case():
    assert S.fingerprint(b"The QUICK brown fox") == S.fingerprint(b"the quick BROWN Fox")
    assert S.fingerprint("É b c".encode()) != S.fingerprint("é b c".encode())


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(5000))
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "CHUNK", 64)
    assert S.fingerprint(text.encode()) == whole == plain(text)


def clustered(n, rng):
    """Random fingerprints, near ones of some, and a crowd that shares two thirds of its bits."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for base in out[:n // 4]:
        near = base
        for _ in range(4):
            near ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            out.append(near)
    crowd = rng.getrandbits(64)
    out += [crowd ^ (rng.getrandbits(64) & 0x1FFFFF) for _ in range(n)]
    return sorted({x - (1 << 64) if x >= 1 << 63 else x for x in out})


def test_links_equal_all_pairs(spark):
    fps = clustered(400, random.Random(4))
    u = np.array(fps, np.int64).view(np.uint64)
    want = set()
    for k, x in enumerate(u):
        for j in np.flatnonzero(np.bitwise_count(u[k + 1:] ^ x) <= 2):
            want.add((fps[k], fps[k + 1 + j]))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r["a"], r["b"]) for r in S.links(df).collect()}
    assert want and got == want


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(0)
    costs = np.cumsum(rng.integers(0, 50, (200, 3, 4)), axis=2).astype(float)
    costs[:, :, 0] = 0
    got = S.thresholds(costs, 2)
    assert (got.sum(axis=1) == 2 - 3 + 1).all()
    every = [(a, b, c) for a in range(4) for b in range(4) for c in range(4) if a + b + c == 3]
    for row, t in zip(costs, got):
        assert sum(row[p, t[p] + 1] for p in range(3)) == min(
            sum(row[p, x[p]] for p in range(3)) for x in every)


def test_correlated_bits_share_a_part(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(500):
        x = rng.getrandbits(64)
        for b in range(0, 20, 2):  # bits b and 63 - b agree
            x = x & ~(1 << 63 - b) | ((x >> b & 1) << 63 - b)
        rows.append((x - (1 << 64) if x >= 1 << 63 else x,))
    groups = S.group_bits(*S.bit_sums(spark.createDataFrame(rows, "fp long")))
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert sum(any(b in g and 63 - b in g for g in groups) for b in range(0, 20, 2)) >= 8


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(got[k] == 0 for k in range(41)) and got[300] == got[200] == 100


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["component_id"] == by_id[5]["component_id"] == 4
    texts = {r[0]: r[1] for r in edge_rows()}
    for k, r in by_id.items():  # document 6 has upper-case letters beyond A-Z, which stay as they are
        if k is not None:
            assert r["fp"] & (1 << 64) - 1 == plain(texts[k])
    assert {by_id[k]["component_id"] for k in (0, 1, 2, 9)} == {0}
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["component_id"] for r in rows})
    assert kept.where("doc_id = 4").count() == 1 and kept.where("doc_id = 0").count() == 1


def test_ids_all_null(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "x y z w v")],
                               "doc_id long, text string")
    assert {r["component_id"] for r in S.near_duplicates(df).collect()} == {None}
    assert S.keep_first(df).count() == 2


def test_empty_table(spark):
    assert S.near_duplicates(empty_docs(spark)).count() == 0
    assert S.keep_first(empty_docs(spark)).count() == 0
