"""Small tables with every awkward case, for all corpus operators."""

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["k1", "k2", "g", "fp", "part", "block", "row", "h1", "kept", "lines", "covered", "pos", "d2",
            "start", "value", "q", "leaf", "depth", "__row", "__words", "c", "n"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and an house tree river stone walks sees Über café naïve 東京 "
                               "quick brown fox jumps over lazy dog".split()) for _ in range(n))


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    body = "\n".join(sentence(rng, 12) for _ in range(8))
    rows = [(None, None, None, None, None), (0, None, "en", "a", None), (1, "", "en", "a", 0),
            (2, " \t\n\x0b\f\r ", "en", None, 7), (3, "word", None, "a", 4), (4, body, "en", "a", len(body)),
            (4, body, "en", "a", len(body)), (4, body, "en", "a", len(body)), (5, body, "en", "b", len(body)),
            (None, body, "en", "a", len(body)), (None, body, "en", "a", len(body)),
            (6, body.upper(), "en", "a", len(body)), (7, sentence(rng, 60_000), "en", "a", None),
            (8, "x" * 200_000, "en", "a", None), (9, "\n" * 5000, "en", "a", None),
            (10, "a\u0085b c d\x00e", "fr", "a", None), (11, "line\n" * 3000, "fr", "a", None),
            (12, "<|endoftext|> <|im_start|>", "fr", "a", None)]
    rows += [(100 + k, sentence(rng, 80 + k), "en", "a", None) for k in range(12)]
    return rows


def edge_docs(spark, clashing: bool = True):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    if clashing:
        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
