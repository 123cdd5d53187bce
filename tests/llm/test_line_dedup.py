import random

from tests.llm.helpers import edge_docs, empty_docs
from veilwatch.llm import line_dedup as L


def brute(rows):
    """Remove lines covered by a later occurrence of a window, in (doc_id, text) order."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows)):
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k:k + 3])
            if window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        out[doc_id, text] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, "\n".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()}
    assert got == {k: want[k, t] for k, t in rows}


def test_passage_stays_once(spark):
    passage = "\n".join(f"shared line {k}" for k in range(6))
    rows = [(k, f"own {k}\n{passage}\nend {k}") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.dedup_lines(df).collect()}
    assert got[0]["text"] == rows[0][1]
    assert all(got[k]["text"] == f"own {k}\nend {k}" and got[k]["n_removed"] == 6 for k in range(1, 5))


def test_edge_rows(spark):
    docs = edge_docs(spark)
    out = L.dedup_lines(docs).collect()
    assert len(out) == docs.count()
    by_id = {}
    for r in out:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[0][0]["text"] is None and by_id[1][0]["text"] == ""
    assert {r["text"] for r in by_id[4]} == {docs.where("doc_id = 4").first()["text"]}
    assert by_id[5][0]["text"] == ""  # a copy of document 4
    assert by_id[11][0]["lines"] == "own lines" and by_id[11][0]["n_removed"] > 2900
    same = L.dedup_documents(docs)
    assert same.columns == docs.columns
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in same.collect())


def test_empty_table(spark):
    assert L.dedup_lines(empty_docs(spark)).count() == 0
