"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers (``floor(scale * entry)``) and every distinct vector is fitted once.  The leading
eigenvectors of their covariance come from a block Q of a few dozen columns: a pass over the fit list
gives V·Q = Xᵀ(XQ)/n with the rows centred before they are multiplied, tasks add up their part and Spark
adds the parts by dimension.  The passes of one step apply a Chebyshev polynomial of V that stays small on
the unwanted part of the spectrum and grows quickly above it; QR and a Rayleigh-Ritz step turn the block
into Ritz pairs.  Steps go on until every wanted pair is certified: its residual, measured by a pass of
its own, is at the level of rounding or no longer falls.  The unwanted part is bounded below by a short
Lanczos run and above by the block's last Ritz value.

The covariance itself is never formed and no row leaves its task; what reaches the driver is a block, its
size the dimension times ``block`` numbers.  Sums and squared deviations are exact integers.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, as are empty
vectors and vectors of another length than the most frequent one (the longer one of a tie), which have no
place in the same space.  Repeated rows are fitted once and returned each; null or repeated vec_ids are
carried.  Components without variance (above rounding) cannot be scaled to one and are not returned; so a
table of one distinct vector, or an empty one, gives no rows.  Components of equal variance are any
orthonormal basis of their space.  A squared deviation beyond a long is null.  Entries beyond a long after
scaling count as its ends.  Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import field, pack_row, settled, ship_code

#: An entry is multiplied by this and rounded down.
SCALE = 256.0
COMPONENTS = 4
#: Columns of the block: the wanted ones and guards that move the unwanted spectrum away from them.
BLOCK = 32
#: Degree of the polynomial of one step, and of the Lanczos run that bounds the spectrum below.
DEGREE = 10
LANCZOS = 12
#: By how much a step may raise the largest eigenvector over the unwanted ones.
MOST = 1e14
#: Steps after which a spectrum that does not settle is an error.
STEPS = 200
_LONG = 2 ** 63


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def integers(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """``vec_id`` and the vector as longs ``x``, for the rows whose vector can be used."""
    df = pack_row(embeddings)
    df = df.select(field(df, "vec_id", "long").alias("vec_id"),
                   field(df, "embedding", "array<double>").alias("v"))
    good = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col("v").isNotNull() & (F.size("v") > 0) & good).select(
        "vec_id", F.transform("v", lambda c: F.floor(F.lit(scale) * c) + F.lit(0).cast("long")).alias("x"))


def _usual_length(vectors: DataFrame) -> int:
    top = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


@dataclass
class Centre:
    """Number of fitted vectors, exact sums per dimension and the largest absolute entry."""

    n: int
    sums: list[int]
    largest: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; the mean's whole part is taken off as an integer."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        kind = np.int64 if self.largest < 2 ** 62 else object
        return (x.astype(kind) - np.array(whole, kind)).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum of (n·x - S)², null beyond a long.

        Products wrap at 2**64, so a sum below 2**63 comes out exact; which ones are is told by a rounded
        sum, near the limit by Python integers.
        """
        rounded = ((self.centred(x) * float(self.n)) ** 2).sum(axis=1)
        low = np.array([s % 2 ** 64 for s in self.sums], np.uint64)
        off = x.astype(np.uint64) * np.uint64(self.n) - low
        out = (off * off).sum(axis=1, dtype=np.uint64).astype(object)
        for k in np.flatnonzero(rounded > 0.99 * _LONG):
            exact = sum((self.n * a - s) ** 2 for a, s in zip(x[k].tolist(), self.sums))
            out[k] = exact if exact < _LONG else None
        return out.tolist()


def centre(fit: DataFrame, dim: int) -> Centre:
    """Exact sums: entries are split into high and low halves, so no task's sums overflow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, most = (np.zeros(dim, np.int64) for _ in range(3))
        n = 0
        for batch in batches:
            x = _rows(batch.column(0), dim)
            if len(x):
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                most = np.maximum(most, np.maximum(x.max(axis=0) - 0, -(x.min(axis=0) + 1)))
                n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dim)), pa.array(high), pa.array(low), pa.array(most),
             pa.array(np.full(dim, n))], names=["pos", "high", "low", "most", "n"])

    wide = "decimal(38,0)"
    rows = fit.select("x").mapInArrow(run, "pos long, high long, low long, most long, n long").groupBy(
        "pos").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"),
                   F.max("most").alias("most"), F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: r["pos"])
    return Centre(rows[0]["n"] if rows else 0, [int(r["high"]) * 2 ** 32 + int(r["low"]) for r in rows],
                  max((r["most"] + 1 for r in rows), default=0))


def added(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int],
          dim: int) -> np.ndarray:
    """The sum over all rows of ``part``, a matrix of ``shape`` for some rows.

    A task yields its own sum as one row per line of the matrix; Spark adds them up line by line.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(_rows(batch.column(0), dim))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(shape[0])), *[pa.array(c) for c in total.T]],
            names=["pos", *[f"v{k}" for k in range(shape[1])]])

    names = [f"v{k}" for k in range(shape[1])]
    rows = fit.select("x").mapInArrow(run, "pos long, " + ", ".join(f"{v} double" for v in names)).groupBy(
        "pos").agg(*[F.sum(v).alias(v) for v in names]).collect()
    rows.sort(key=lambda r: r["pos"])
    return np.array([[r[v] for v in names] for r in rows]).reshape(shape)


class Covariance:
    """V·Q by one pass over the fit list."""

    def __init__(self, fit: DataFrame, middle: Centre, dim: int):
        self.fit, self.middle, self.dim, self.passes = fit, middle, dim, 0

    def times(self, q: np.ndarray) -> np.ndarray:
        middle = self.middle

        def part(x: np.ndarray) -> np.ndarray:
            c = middle.centred(x)
            return c.T @ (c @ q)

        self.passes += 1
        return added(self.fit, part, q.shape, self.dim) / middle.n

    def trace(self) -> float:
        middle = self.middle
        return float(added(self.fit, lambda x: np.array([[(middle.centred(x) ** 2).sum()]]), (1, 1),
                           self.dim)[0, 0]) / middle.n


def lowest(times: Callable[[np.ndarray], np.ndarray], dim: int, rng: np.random.Generator,
           steps: int = LANCZOS) -> float:
    """A value near the least eigenvalue, from below: least Ritz value of a Lanczos run, less its residual."""
    q = np.linalg.qr(rng.standard_normal((dim, 1)))[0]
    basis, alpha, beta = q, [], []
    for _ in range(min(steps, dim)):
        w = times(basis[:, -1:])
        alpha.append(float(basis[:, -1] @ w[:, 0]))
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(abs(a) for a in alpha) or basis.shape[1] == dim:
            break
        basis = np.hstack([basis, w / beta[-1]])
    t = np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1) + np.diag(beta[:len(alpha) - 1], -1)
    values, vectors = np.linalg.eigh(t)
    return max(0.0, float(values[0] - beta[len(alpha) - 1] * abs(vectors[-1, 0])))


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, top: float,
             degree: int) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` for [low, high], scaled to about 1 at ``top``, applied to q.

    The degree is lowered where ``top`` would outgrow the unwanted part beyond what a double can hold beside.
    """
    half, middle = (high - low) / 2, (high + low) / 2
    degree = max(2, min(degree, int(np.arccosh(MOST) / np.arccosh((top - middle) / half))))
    first = half / (top - middle)
    sigma = first
    before, now = q, (times(q) - middle * q) * (sigma / half)
    for _ in range(1, degree):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - middle * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], dim: int, components: int, block: int = BLOCK,
            degree: int = DEGREE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``components`` largest eigenvalues of V, their unit vectors and certified residuals."""
    rng = np.random.default_rng(seed)
    size = min(dim, max(block, 2 * components))
    wanted = min(components, dim)
    q = np.linalg.qr(rng.standard_normal((dim, size)))[0]
    low = lowest(times, dim, rng) if size < dim else 0.0
    best = None
    for step in range(STEPS):
        vq = times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        level = float(residual.max(initial=0))
        floor = 8 * np.finfo(float).eps * max(float(values[0]), 0.0)
        if best is not None and level > best[0] / 2 and best[0] <= 1e-9 * values[0]:
            if best[0] <= level:
                return best[1], best[2], best[3]
            return values[:wanted], q[:, :wanted], residual
        if best is None or level < best[0]:
            best = level, values[:wanted].copy(), q[:, :wanted].copy(), residual
        if size == dim and step or level <= floor:
            return best[1], best[2], best[3]
        high = float(values[-1])
        if size == dim or high <= low or values[0] - high <= 1e-12 * values[0]:
            q = np.linalg.qr(vq)[0] if size < dim else np.linalg.qr(q)[0]  # nothing to damp: a plain step
        else:
            q = np.linalg.qr(filtered(times, q, min(low, high / 2), high, float(values[0]), degree))[0]
    raise RuntimeError(f"no certified components after {STEPS} steps: residual {best[0]}")


def whitened(embeddings: DataFrame, components: int = COMPONENTS, scale: float = SCALE, block: int = BLOCK,
             degree: int = DEGREE) -> DataFrame:
    """One row per usable vector and component: ``vec_id``, ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``."""
    spark = embeddings.sparkSession
    ship_code(spark)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    vectors = settled(integers(embeddings, scale))
    dim = _usual_length(vectors)
    vectors = vectors.where(F.size("x") == dim)
    fit = settled(vectors.select("x").distinct())
    middle = centre(fit, dim) if dim else Centre(0, [], 0)
    v = Covariance(fit, middle, dim)
    trace = v.trace() if middle.n > 1 else 0.0
    if trace <= 0:
        return spark.createDataFrame([], schema)
    values, axes, _ = leading(v.times, dim, components, block, degree)
    some = values > 16 * np.finfo(float).eps * dim * trace
    values, axes = values[some], axes[:, some]
    to_unit = axes / np.sqrt(values)
    k = len(values)
    mean = added(fit, lambda x: (middle.centred(x) @ to_unit).sum(axis=0)[None, :], (1, k), dim) / middle.n

    def products(x: np.ndarray) -> np.ndarray:
        w = middle.centred(x) @ to_unit - mean
        return w.T @ w

    error = float(np.abs(added(fit, products, (k, k), dim) / middle.n - np.eye(k)).max())
    shares = values / trace
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column(1), dim)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(rows), middle.n)),
                 pa.array(middle.deviations(x), pa.int64()).take(pa.array(rows)),
                 pa.array((middle.centred(x) @ to_unit).ravel()), pa.array(np.tile(shares, len(x))),
                 pa.array(np.full(len(rows), error))], names=names)

    return vectors.select("vec_id", "x").mapInArrow(run, schema)
