import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tests.llm.helpers import SF, edge_docs, empty_docs
from veilwatch.llm import token_counts as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def stored_rows(spark, path):
    return spark.read.parquet(path).count()


def expected(rows, count):
    return sorted(((r["doc_id"], len((r["text"] or "").encode()), count(r["text"] or ""),
                    count(r["text"] or "") > C.LIMIT) for r in rows), key=repr)


@pytest.mark.parametrize("path", [MODEL, JSON])
def test_equals_the_library(spark, tmp_path, path):
    if path is MODEL:
        model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
        count = lambda t: len(model.encode(t))
    else:
        whole = Tokenizer.from_file(JSON)
        count = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), edge_docs(spark)):
        got = C.counts(docs, path, str(tmp_path / "cache"))
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        rows = docs.select("doc_id", "text").collect()
        assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, count)
        assert any(r[3] for r in got.collect())


def test_pieces_keep_the_count():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert C._cuttable(MODEL)
    texts = ["a  b   c d", "  lead and trail  ", "▁ x ▁y z", "\n \n a\t b", "x" * 50, " " * 50,
             "naïve \x00 東京 ﬁ 😀 end ", "</s> <s> <unk> a", "word " * 30]
    for text in texts:
        for size in (1, 2, 3, 7):
            assert C.count_texts([text], MODEL, size) == [len(model.encode(text))], (text, size)


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)
    before = C._encoded

    def watched(texts, model):
        seen.add(texts.count())
        return before(texts, model)

    C._encoded = watched
    try:
        rows = [(k, f"text {k % 3}") for k in range(60)] + [(60, None), (61, "")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        first = sorted(map(tuple, C.counts(docs, MODEL, path).collect()))
        assert seen.value == 4 and stored_rows(spark, path) == 4
        for few, hot in ((0, 1), (C.FEW, C.HOT)):  # every way gives the same rows
            assert sorted(map(tuple, C.counts(docs, MODEL, path, few=few, hot=hot).collect())) == first
        assert seen.value == 4 and stored_rows(spark, path) == 4
        more = docs.union(spark.createDataFrame([(90, "a new text"), (91, "a new text")], docs.schema))
        for few in (0, C.FEW):
            got = C.counts(more, MODEL, path, few=few).where("doc_id >= 90").collect()
            assert [r["n_bytes"] for r in got] == [10, 10]
        assert seen.value == 5 and stored_rows(spark, path) == 5
        C.counts(docs, JSON, path).collect()  # another tokenizer has counts of its own
        assert seen.value == 9 and stored_rows(spark, path) == 9
    finally:
        C._encoded = before


def test_counts_stored_twice_are_read_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    C.counts(docs, MODEL, path).collect()
    spark.read.parquet(path).cache().write.mode("append").partitionBy("tokenizer").parquet(path)
    assert stored_rows(spark, path) == 4 and C.counts(docs, MODEL, path).count() == 2


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert C.counts(empty_docs(spark), MODEL, path).count() == 0
    assert not (tmp_path / "cache").exists()
    assert C.counts(spark.createDataFrame([(1,)], "doc_id long"), MODEL, path).select(
        F.sum("n_tokens")).first()[0] == 0
