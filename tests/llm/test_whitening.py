import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import CLASHING, SF
from veilwatch.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, scale=256.0):
    """Whitening by a full eigendecomposition: rows, eigenvalues, axes."""
    good = [(i, [math.floor(scale * c) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float)
    c = x - np.array(sums) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, v in good:
        w = (np.array(v) - np.array(sums) / n) @ axes[:, :4] / np.sqrt(values[:4])
        far = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        out.setdefault(i, []).append((far if far < 2 ** 63 else None, w))
    return n, out, values, values.sum()


def check(spark, rows, **options):
    n, want, values, trace = brute(rows)
    got = W.whitened(spark.createDataFrame(rows, SCHEMA), **options).collect()
    k = min(4, len(values))
    assert len(got) == k * sum(map(len, want.values()))
    signs = {}
    for r in got:
        j = r["component"] - 1
        best = next(o for o in want[r["vec_id"]] if o[0] == r["deviation"])
        assert r["n"] == n
        assert r["explained"] == pytest.approx(values[j] / trace, rel=1e-9) and r["identity_error"] < 1e-9
        if abs(best[1][j]) > 1e-3:
            signs.setdefault(j, np.sign(best[1][j] * r["whitened"]))
            assert r["whitened"] * signs[j] == pytest.approx(best[1][j], abs=1e-7)
    return got


@pytest.mark.parametrize("block, degree", [(32, 10), (8, 12)])
def test_equals_full_eigendecomposition(spark, block, degree):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(spark, rows + rows[:7], block=block, degree=degree)


def test_awkward_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(c) for c in rng.normal(size=6) * [1, 2, 3, 4, 5, 6]]) for k in range(40)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0]),
           (103, [1.0, float("inf"), 1.0, 1.0, 1.0, 1.0])]
    check(spark, rows + rows[:3] + bad)
    odd = [(104, []), (105, [1.0, 2.0]), (None, rows[0][1])]
    docs = spark.createDataFrame(rows + bad + odd, SCHEMA).withColumns({c: F.lit("own") for c in CLASHING})
    got = W.whitened(docs)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted({r["vec_id"] for r in got.collect()}, key=repr) == sorted([*range(40), None], key=repr)


def test_few_dimensions_and_no_variance(spark):
    rows = [(k, [float(k % 5), float(k % 3)]) for k in range(30)]
    assert {r["component"] for r in check(spark, rows)} == {1, 2}
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], SCHEMA)
    assert {r["component"] for r in W.whitened(line).collect()} == {1}
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], SCHEMA)
    assert W.whitened(same).count() == 0
    assert W.whitened(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_beyond_a_double(spark):
    for scale in (2 ** 14, 2 ** 17, 2 ** 19, 2 ** 20):  # sums of squares around 2**63
        rows = [(k, [float(scale * (k % 7) + 1), -float(2 * scale * (k % 5))]) for k in range(35)]
        got = check(spark, rows)
        assert any(r["deviation"] is None for r in got) == (scale > 2 ** 14)
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])], SCHEMA)
    rows = W.whitened(huge).collect()
    assert rows and all(r["deviation"] is None or r["deviation"] >= 0 for r in rows)


def test_filter_damps_the_unwanted_spectrum():
    values = np.array([9.0, 8, 7, 6, 5, *np.linspace(1, 2, 60)])
    q = np.eye(len(values))
    out = np.diag(W.filtered(lambda y: values[:, None] * y, q, 1.0, 2.0, 9.0, 12))
    assert np.abs(out[5:]).max() < 1e-9 * abs(out[4]) < 1 and abs(out[0]) > abs(out[4])


@pytest.mark.parametrize("seed", range(3))
def test_leading_pairs_are_certified(seed):
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    values = np.sort(rng.random(200))[::-1] + 1  # no gap anywhere
    v = (axes * values) @ axes.T
    passes = []
    found, vectors, residual = W.leading(lambda y: passes.append(1) or v @ y, 200, 4)
    assert np.allclose(found, values[:4], rtol=1e-12) and residual.max() < 1e-12
    assert np.abs(np.abs((vectors * axes[:, :4]).sum(axis=0)) - 1).max() < 1e-12
    assert len(passes) < 200
