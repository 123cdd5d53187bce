import random

from pyspark.sql import functions as F

from tests.llm.helpers import edge_docs, empty_docs, sentence
from veilwatch.llm import decontaminate as D


def best_distance(item, text):
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at, how = rng.randrange(len(text)), rng.randrange(3)
        text[at:at + 1] = [["#"], [], [text[at], "@"]][how]
    return "".join(text)


def case(rng, n):
    items = [(k, D.folded(sentence(rng, rng.randrange(12, 40)) + f" item {k} ends")) for k in range(12)]
    docs = []
    for k in range(n):
        body = sentence(rng, rng.randrange(5, 60))
        if k % 2:
            _, item = rng.choice(items)
            body += " " + edited(rng, item, rng.randrange(0, len(item) // 6)) + " " + sentence(rng, 10)
        docs.append((k, body))
    return items, docs


def test_equals_brute_force(spark):
    items, docs = case(random.Random(8), 60)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.find(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    index = D.Index.build(items)
    want = {}
    for doc_id, text in docs:
        for (item_id, item), edits in zip(items, index.edits):
            d = best_distance(D.folded(item), D.folded(text))
            if d <= edits:
                want[doc_id, item_id] = d
    assert len(want) > 10 and got == want


def test_places():
    item = "the quick brown fox jumps over the lazy dog again and again"
    text = "before " + item + " between " + item.replace("fox", "cat") + " after"
    found = D.matches([text], D.Index.build([(1, item)]))
    assert [(s, e) for _, _, s, e, _ in found] == [(7, 7 + len(item)), (16 + len(item), 16 + 2 * len(item))]
    assert [x[4] for x in found] == [0, 3]


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(12)
    items, _ = case(rng, 1)
    index = D.Index.build(items)
    text = " ".join(sentence(rng, 30) + " " + edited(rng, rng.choice(items)[1], 3) for _ in range(40))
    whole = D.matches([text], index)
    monkeypatch.setattr(D, "PIECE", 300)
    assert len(whole) >= 35 and D.matches([text], index) == whole


def test_case_and_white_space_do_not_hide():
    item = "The Quick brown fox jumps over the lazy dog and on"
    assert D.matches([item.upper().replace(" ", " \n\t")], D.Index.build([(1, item)]))


def test_other_scripts():
    item = "東京都は日本の首都であり、世界最大級の都市圏を形成している。人口は多い。"
    index = D.Index.build([(1, item)])
    assert D.matches(["始め" + item + "終り"], index)
    assert not D.matches(["まったく違う文章がここにあります。" * 4], index)


def test_blocks_see_every_item(spark, monkeypatch):
    items, docs = case(random.Random(9), 30)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.find(d, b).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    assert len(list(D.blocks(b))) > 3
    assert sorted(map(tuple, D.find(d, b).collect())) == whole
    dirty = {r[0] for r in whole}
    assert {r["doc_id"] for r in D.clean(d, b).collect()} == {k for k, _ in docs} - dirty


def test_edge_rows(spark):
    docs = edge_docs(spark)
    text = docs.where("doc_id = 4").first()["text"]
    items = spark.createDataFrame(
        [(1, text[50:200]), (2, None), (3, ""), (4, "short"), (5, text[50:200]), (None, text[250:400])],
        "item_id long, text string")
    found = D.find(docs, items).collect()
    assert {r["item_id"] for r in found} == {1, 5, None}
    assert {r["doc_id"] for r in found} == {4, 5, 6, None}
    assert sum(r["doc_id"] == 4 and r["item_id"] == 1 for r in found) == 3  # repeated rows each
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 7


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = edge_docs(spark)
    assert D.find(docs, none).count() == 0
    assert D.clean(docs, none).count() == docs.count()
    some = spark.createDataFrame([(1, "some passage of a benchmark")], "item_id long, text string")
    assert D.find(empty_docs(spark), some).count() == 0
    assert docs.select(F.count(F.lit(1))).first()[0] > 0


def test_long_runs_of_equal_characters():
    """A drawn rule in a text against one in an item: time and memory grow with the text, not with their product."""
    import resource
    import time

    index = D.Index.build([(1, "answer " + "-" * 200), (2, "=" * 64 + " total " + "=" * 64)])
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    texts = ["answer " + "-" * 300_000, "x" + "=" * 100_000 + " total " + "=" * 100_000, "- " * 20_000]
    found = D.matches(texts, index)
    assert time.time() - start < 120 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert {(t, i) for t, i, *_ in found} == {(0, 0), (1, 1)}
    assert (0, 0, 0, 207, 0) in found
