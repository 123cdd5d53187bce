"""Masking of texts in pieces against masking of whole texts."""

import random

from pyspark.sql import functions as F

from veilwatch.functions.masking import mask_text
from veilwatch.operators.text_pieces import cut_texts, mask_pieces

BEGIN, END = "-----BEGIN {} PRIV" + "ATE KEY-----", "-----END {} PRIV" + "ATE KEY-----"
PARTS = [BEGIN.format("RSA"), BEGIN.format("A B"), END.format("RSA"), END.format("EC"), "-----", "BEGIN RSA PRIV" + "ATE KEY-----",
         "END RSA PRIV" + "ATE KEY-----", "password", "TOKEN", "=", ":", " ", "\n", "\n", "\n", "\t", "\u00a0", "hunter22hunter", "x", "abc",
         "me@mail.example", "0f" * 16, "AK" + "IA" + "Q7" * 8, "xo" + "xb-" + "1" * 10, "'", '"', "word word", "\r\n", "é😀"]


def _whole(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    return {r[0]: r[1] for r in df.select("text_id", mask_text(F.coalesce("text", F.lit("")))).collect()}


def _joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["text_id"], r["piece"])):
        out[r["text_id"]] = out.get(r["text_id"], "") + r["text"]
    return out


def test_pieces_equal_the_whole_for_any_cut(spark):
    rng = random.Random(5)
    texts = ["", "\n", "a", BEGIN.format("X"), END.format("X"), BEGIN.format("X") + END.format("X"),
             END.format("A") + BEGIN.format("B")[5:] + "x\ny\n" + END.format("B") + "password=" + BEGIN.format("C")
             + "\n" * 30 + END.format("C") + "rest of it"]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 120))) for _ in range(400)]
    pieces = []
    for k, text in enumerate(texts):
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(0, 30)))
        ends = [0, *cuts, len(text)]
        pieces += [(k, 3 * n + rng.randrange(3), text[a:b]) for n, (a, b) in enumerate(zip(ends, ends[1:]))]
    got = _joined(mask_pieces(spark.createDataFrame(pieces, "text_id long, piece int, text string"), 8))
    want = _whole(spark, texts)
    assert {k: (texts[k], got.get(k), want[k]) for k in want if got.get(k) != want[k]} == {}


def test_own_cuts_nulls_and_empty_tables(spark):
    texts = [None, "", "mail me@mail.example now\n" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    assert _joined(mask_pieces(cut_texts(df, 7))) == _whole(spark, texts)
    assert mask_pieces(cut_texts(df.limit(0))).count() == 0


def test_a_block_over_many_pieces_leaves_one_label_and_small_rows(spark):
    """One text of 3,000 pieces: no row grows beyond a few lines."""
    line = "plain words and me@mail.example\n" * 20
    pieces = spark.range(3000).select(
        F.lit(1).cast("long").alias("text_id"), F.col("id").alias("piece"),
        F.when(F.col("id") == 10, F.lit(BEGIN.format("RSA") + "\n")).when(F.col("id") == 2900, F.lit(END.format("RSA") + "tail\n"))
        .otherwise(F.lit(line)).alias("text"))
    done = mask_pieces(pieces).agg(F.max(F.length("text")), F.sum(F.length("text"))).first()
    masked = len("plain words and [EMAIL]\n") * 20
    assert done[0] <= masked + 100
    assert done[1] == masked * (10 + 99) + len("[PRIVATE_KEY_BLOCK]tail\n")


def test_texts_go_with_their_prefix_sums(spark):
    from veilwatch.operators.prefix import before

    rows = spark.createDataFrame([(1, k, k % 2, f"t{k}") for k in range(5)], "text_id long, piece long, n long, text string")
    got = before("text_id", rows, ["n"], [], 2, ("text",)).orderBy("piece").collect()
    assert [(r["piece"], r["text"], r["n"], r["n_all"]) for r in got] == [
        (0, "t0", 0, 2), (1, "t1", 0, 2), (2, "t2", 1, 2), (3, "t3", 1, 2), (4, "t4", 2, 2)]


def test_texts_never_go_to_an_uncompressed_checkpoint(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "checkpoint", lambda *a, **b: 1 / 0)
    texts = [f"{BEGIN.format('RSA')}\nabc\n{END.format('RSA')}rest me@mail.example\n" * 5, "plain\n" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    assert _joined(mask_pieces(cut_texts(df, 11), 3)) == _whole(spark, texts)
