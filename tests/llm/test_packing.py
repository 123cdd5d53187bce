import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import edge_docs, empty_docs
from veilwatch.llm import packing as P

FILES = P.public_tokenizer()


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(FILES["json"])
    found.encode_special_tokens = True
    return found


def test_ids_of_every_code_point(reference):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 40_000):
        texts = [f"a{chr(c)}b1{chr(c)}2 {chr(c)}{chr(c)}  {chr(c)}'s \n {chr(c)}!" for c in points[at:at + 40_000]]
        for text, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
            assert P.token_ids(text, FILES).tolist() == [*want.ids, 0]


def test_special_strings_and_long_runs(reference):
    for text in ("<|endoftext|>", "a <|endoftext|> b", " " * 50_000 + "x", "x" * 50_000, "\n" * 9999, ""):
        assert P.token_ids(text, FILES).tolist() == [*reference.encode(text, add_special_tokens=False).ids, 0]


def check_packed(rows, length, segments):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for some in by.values():
        some.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in some] == np.cumsum([0, *[r["length"] for r in some]])[:-1].tolist()
        assert sum(r["length"] for r in some) <= length and len(some) <= segments
    return by


def test_round_trip(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    rows = P.pack(docs, FILES).collect()
    by = check_packed(rows, P.LENGTH, P.SEGMENTS)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*reference.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at:at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    tokens = sum(r["length"] for r in rows)
    assert 1 - tokens / (P.LENGTH * len(by)) < 0.05


def test_limits_of_all_dimensions(spark):
    rng = np.random.default_rng(0)
    rows = [(k, "word " * int(n), int(n * f)) for k, (n, f) in enumerate(
        zip(rng.integers(1, 120, 400), rng.random(400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt long")
    out = P.pack(docs, FILES, length=256, segments=5, loss_limit=100, loss_from="prompt").collect()
    by = check_packed(out, 256, 5)
    assert len(out) == 400
    for some in by.values():
        assert len(some) == 1 or sum(r["loss"] for r in some) <= 100


def test_dot_product_heuristic_fills():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 500)
    bins = P.fill(np.stack([sizes, np.ones(500), sizes], axis=1), np.array([100, 64, 100]))
    used = np.bincount(bins, sizes)
    assert used.max() <= 100 and len(used) <= np.ceil(sizes.sum() / 100) * 1.05


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows = P.pack(docs, FILES).collect()
    check_packed(rows, P.LENGTH, P.SEGMENTS)
    ends = [r for r in rows if r["start"] + r["length"] == r["doc_tokens"]]
    assert len(ends) == docs.count()  # every row once, repeated ones too
    assert [r["doc_tokens"] for r in ends if r["doc_id"] in (0, 1)] == [1, 1]


def test_empty_table(spark):
    assert P.pack(empty_docs(spark), FILES).count() == 0


def test_groups_do_not_change_the_pieces(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cols = ["doc_id", "start", "length", "ids_crc32"]
    few, many = P.pack(docs, FILES), P.pack(docs, FILES, group=16)
    assert few.select(cols).exceptAll(many.select(cols)).count() == 0
    assert many.select(F.countDistinct("sequence_id")).first()[0] >= few.select(
        F.countDistinct("sequence_id")).first()[0]
