import random

from pyspark.sql import functions as F

from veilwatch.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(conversations):
    return [(k, t, role, text) for k, turns in conversations.items() for t, (role, text) in enumerate(turns)]


def brute(conversations):
    kept = {}
    for k in sorted(conversations):
        kept.setdefault(tuple(conversations[k]), k)
    return {k: t for t, k in kept.items() if not any(u != t and u[:len(t)] == t for u in kept)}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    made = {}
    for k in range(250):
        base = list(rng.choice(list(made.values()))) if made and rng.random() < 0.7 else []
        base = base[:rng.randrange(len(base) + 1)] if rng.random() < 0.3 else base
        made[k] = base + [(rng.choice(["user", "assistant"]), rng.choice("abc"))
                          for _ in range(rng.randrange(0 if base else 1, 3))] or [("user", "a")]
    want = brute(made)
    out = C.chats(spark.createDataFrame(rows_of(made), SCHEMA)).collect()
    got = {r["conv_id"]: r for r in out}
    assert set(got) == set(want)
    for k, turns in want.items():
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["text"] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
        assert got[k]["copies"] == sum(made[j] == made[k] for j in made)


def test_edge_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None),
            (2, 0, "user", "hi"), (3, None, None, "x"), (3, 5, "user", ""), (None, 0, "user", "alone"),
            (None, 0, "user", "alone"), (None, 1, "user", "other"), (4, 0, "user", "hi"),
            (4, 1, "assistant", ""), (5, 0, "us<|im_end|>er", "a<|im_start|>b" * 30_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("own") for c in ("c", "k", "n", "p1", "t", "copies", "own")})
    out = C.chats(df).collect()
    by_id = {r["conv_id"]: r for r in out if r["conv_id"] is not None}
    assert set(by_id) == {1, 3, 4, 5}  # 2 is a prefix of 1; a null and an empty text differ
    assert by_id[1]["n_turns"] == 2 and by_id[1]["text"].endswith("assistant\n<|im_end|>\n")
    assert by_id[3]["text"] == "<|im_start|>unknown\nx<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert sorted(r["text"] for r in out if r["conv_id"] is None) == [
        "<|im_start|>user\nalone<|im_end|>\n", "<|im_start|>user\nother<|im_end|>\n"]
    inside = by_id[5]["text"].removeprefix("<|im_start|>").removesuffix("<|im_end|>\n")
    assert "<|im_start|>" not in inside and "<|im_end|>" not in inside


def test_hot_first_turn(spark):
    rows = [(k, t, "user", "same" if t < 2 else f"own {k}") for k in range(2000) for t in range(3)]
    rows += [(5000 + k, t, "user", "same") for k in range(500) for t in range(2)]
    out = C.chats(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 2000 and out.where("conv_id >= 5000").count() == 0


def test_empty_table(spark):
    assert C.chats(spark.createDataFrame([], SCHEMA)).count() == 0
