import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import edge_docs, edge_rows, empty_docs
from veilwatch.llm import quality_rules as Q


def counted(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k:k + 3]), []).append(k)
    covered = {p + o for at in seen.values() if len(at) > 1 for p in at for o in range(3)}
    lines = [x for x in text.split("\n") if x.strip(Q.SPACE)]
    return (len(words), sum(map(len, words)), sum(text.count(s) for s in Q.SYMBOLS),
            len(lines) - len(set(lines)), len(covered))


def test_counts_equal_plain_python(spark):
    texts = [r[1] for r in edge_rows()] + [
        "a b c a b c", "a b a b a b", "a a a a", "x y z\nx y z\n \nx y z", "#1 | 2 $ <b> & *% >",
        "one two", "a b c d a b c x b c d"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = Q.with_counts(df, F.col("text")).select("k", *Q.COUNTS, "base_failed").collect()
    for r in got:
        want = counted(texts[r["k"]])
        assert tuple(r[c] for c in Q.COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def least_determinant(x, steps=60):
    """Concentration steps from many random starts, with the operator's floors."""
    rng = np.random.default_rng(1)
    h, best = (len(x) + x.shape[1] + 1) // 2, None
    for _ in range(30):
        own = x[rng.choice(len(x), h, replace=False)]
        for _ in range(steps):
            mu, cov = own.mean(0), np.cov(own.T, bias=True) + np.diag(np.square(Q.FLOORS))
            d2 = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
            own = x[np.argsort(d2, kind="stable")[:h]]
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = (det, d2)
    return best


def test_estimate_near_brute_force(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(300, 5)) * [1, .5, .1, .3, .3]
    bad = rng.normal(size=(60, 5)) * .1 + [0, 0, 3, 0, 2]
    x = np.vstack([good, bad])
    df = spark.createDataFrame([(1, k, *map(float, r)) for k, r in enumerate(x)],
                               "g long, k2 long, " + ", ".join(f"{s} double" for s in Q.STATS))
    est = Q.minimum_covariance(df, steps=8)
    got = np.array([r["d2"] for r in Q._distance(df.join(est, "g")).orderBy("k2").collect()])
    det, want = least_determinant(x)
    assert est.first()["logdet"] <= det + 0.15
    limit = Q.chi2_quantile(0.9999, 5) * Q.consistency()
    assert (got[300:] > limit).all() and (got[:300] < limit).mean() > 0.97
    assert np.corrcoef(np.sqrt(got), np.sqrt(want))[0, 1] > 0.98


def test_chi_square():
    assert Q.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert Q.chi2_quantile(0.5, 5) == pytest.approx(4.3515, abs=1e-3)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows = Q.verdicts(docs).collect()
    assert len(rows) == docs.count()
    assert not any(r["kept"] for r in rows if r["doc_id"] in (0, 1, 2, 3, 9))
    assert len({r["kept"] for r in rows if r["doc_id"] == 4}) == 1
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in rows)


def test_empty_table(spark):
    assert Q.verdicts(empty_docs(spark)).count() == 0
    assert Q.keep_good(empty_docs(spark)).count() == 0


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.verdicts(docs).where(~F.col("base_failed")).join(labels, "doc_id").select(
        "kept", "quality").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_each_statistic_alone_rejects(spark):
    rng = np.random.default_rng(11)

    def words(n, low=5, high=7):
        return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(low, high)))
                for _ in range(n)]

    def lines(some, per=10):
        return [" ".join(some[k:k + per]) for k in range(0, len(some), per)]

    usual = ["\n".join(lines(words(rng.integers(150, 250)))) for _ in range(200)]
    own = words(200)
    odd = {"log_words": lines(words(6000)), "log_word_length": lines(words(200, 14, 16)),
           "symbols": lines([w + "#" if k % 2 else w for k, w in enumerate(own)]),
           "dup_lines": words(20)[:1] * 20 + lines(words(80), 16),  # 20 of 25 lines are one word
           "repeat_words": lines(own[:110] + own[:45] + own[110:155], 9)}
    rows = [(k, t) for k, t in enumerate([*usual, *("\n".join(x) for x in odd.values())])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("a")})
    got = {r["doc_id"]: r for r in Q.verdicts(docs).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {name for k, name in enumerate(odd, len(usual)) if got[k]["kept"]} == set()
    assert np.mean([got[k]["kept"] for k in range(len(usual))]) > 0.98
