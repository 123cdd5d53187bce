"""Quality rules: counts inside the row, then robust multivariate outliers per language and source.

Counts are array functions inside the row.  The outlier rule is the minimum covariance determinant:
for every (lang, source) the half of the documents whose covariance matrix has the smallest
determinant is found by concentration steps, and a document is rejected when its Mahalanobis distance
from that half's centre passes a chi-square quantile.  A step is one pass over narrow statistics,
pre-aggregated per group; the half is cut by a histogram of the logarithm of the distance, so no group
is ever brought together, and what a step keeps is one row of sums per group.  Languages are
estimated first; a group starts from its language's estimate, which counts as ``PRIOR`` documents in it.

Defined results: a null text has no words and fails; null lang or source is a group of its own;
repeated rows are judged alike; equal distances fall on the same side of the cut; a group of one
document is its own centre and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.llm.common import ROW, digest, field, id_key, pack_row, settled, unpack_row
from veilwatch.operators.joins import salted_join

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STATS = ("log_words", "log_word_length", "symbols", "dup_lines", "repeat_words")
#: Least standard deviation of each statistic given those before it: a group of nearly equal documents has
#: no tighter scale.  A floor times the square root of the chi-square quantile (5.07) lies inside the range
#: of its statistic, so that each one alone can reject a document.
FLOORS = (0.1, 0.03, 0.02, 0.12, 0.12)
DIM = len(STATS)
STEPS = 5
#: Resolution of the distance histogram, per doubling of the distance.
GRID = 32
REJECT_P = 0.9999
#: Weight of a language's estimate in that of each of its groups, in documents.
PRIOR = 100
#: Tasks that the rows of one group are spread over in the joins with its estimate; set it to about the
#: number of executors' cores divided by the share of the largest group.
SALTS = 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(df: DataFrame, text: Column) -> DataFrame:
    """Add the ``COUNTS`` of a text, the number of its lines with a word and ``base_failed``."""
    def at(name: str, k) -> Column:
        return F.get(F.col(name), k)

    df = df.withColumn("__text", F.coalesce(text, F.lit("")))
    df = df.withColumn("__words", F.array_remove(F.split("__text", "[ \\t\\n\\x0B\\f\\r]+"), ""))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"),
                                           lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0))
    n = F.size("__words")
    df = df.withColumn("__win", F.when(n >= 3, F.transform(
        F.slice("__words", 1, F.greatest(n - 2, F.lit(1))),
        lambda w, i: F.xxhash64(w, at("__words", i + 1), at("__words", i + 2)))))
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    df = df.withColumn("__sorted", F.when(repeats, F.sort_array(F.transform(
        "__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("__at", F.sort_array(F.filter(F.transform("__sorted", lambda x, k: F.when(
        (at("__sorted", k + 1)["h"] == x["h"])
        | (F.when(k > 0, at("__sorted", k - 1)["h"]) == x["h"]), x["i"])),
        lambda p: p.isNotNull())))
    covered = F.aggregate(
        F.transform("__at", lambda p, k: F.least(F.lit(3), F.coalesce(at("__at", k + 1) - p, F.lit(3)))),
        F.lit(0), lambda total, step: total + step)
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate("__text", SPACE, "")).cast("long"),
        "n_symbols": (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "__n_lines": F.size("__lines").cast("long")})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (df.withColumn("base_failed", failed)
            .drop("__text", "__words", "__lines", "__win", "__sorted", "__at"))


def _vector(n_lines: Column) -> list[Column]:
    """The transformed statistics: logarithms of sizes, square roots of shares."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log(words), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars),
            F.sqrt(F.col("n_dup_lines") / F.greatest(n_lines, F.lit(1))),
            F.sqrt(F.col("n_repeat_words") / words)]


def _moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and covariance, one row per key."""
    x = [F.col(s) for s in STATS]
    pairs = [(i, j) for i in range(DIM) for j in range(i + 1)]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("m"), *[F.avg(x[i]).alias(f"mu{i}") for i in range(DIM)],
        *[F.covar_pop(x[i], x[j]).alias(f"s{i}{j}") for i, j in pairs])


def _cholesky(df: DataFrame) -> DataFrame:
    """Add the covariance's Cholesky factor ``l..`` and the log determinant.

    What is left of a variance after the statistics before it is at least its floor squared.  The floors are
    those of the whole group, so they are taken back by what the nearest half's covariance is scaled with.
    """
    for j in range(DIM):
        inner = sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(
            F.col(f"s{j}{j}") - inner, F.lit(FLOORS[j] ** 2 / consistency()))))
        df = df.withColumns({f"l{i}{j}": (F.col(f"s{i}{j}") - sum(
            (F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}")
            for i in range(j + 1, DIM)})
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(DIM)), F.lit(0.0))
    return df.withColumn("logdet", logdet)


def _distance(df: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance by forward substitution."""
    for i in range(DIM):
        df = df.withColumn(f"y{i}", (F.col(STATS[i]) - F.col(f"mu{i}") - sum(
            (F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") ** 2 for i in range(DIM)), F.lit(0.0)))


def _starts(rows: DataFrame) -> DataFrame:
    """Two first estimates per group: classical moments, and medians with absolute deviations."""
    classical = _moments(rows, ["g"]).withColumn("start", F.lit(0))
    mid = rows.groupBy("g").agg(F.count(F.lit(1)).alias("m"), *[
        F.percentile_approx(s, [0.25, 0.5, 0.75], 10000).alias(f"q{i}") for i, s in enumerate(STATS)])
    spread = {f"s{i}{j}": ((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / F.lit(1.349)) ** 2 if i == j else F.lit(0.0)
              for i in range(DIM) for j in range(i + 1)}
    robust = mid.withColumns({f"mu{i}": F.col(f"q{i}")[1] for i in range(DIM)} | spread)
    robust = robust.drop(*[f"q{i}" for i in range(DIM)]).withColumn("start", F.lit(1))
    return _cholesky(classical.unionByName(robust))


def _step(rows: DataFrame, est: DataFrame, sizes: DataFrame, salts: int) -> DataFrame:
    """One concentration step: the moments of the half of each group nearest to its estimates."""
    near = _distance(salted_join(rows, est, ["g"], "inner", ["k2"], salts)).withColumn(
        "cell", F.floor(F.log2(F.col("d2") + F.lit(2.0 ** -20)) * GRID).cast("int"))
    cells = near.groupBy("g", "start", "cell").agg(F.count(F.lit(1)).alias("c")).join(sizes, "g")
    half = F.floor(F.col("n") / 2) + 1  # the floors keep any half's covariance regular
    below = F.expr("sum(c) over (partition by g, start order by cell) - c")
    cut = (cells.withColumn("below", below).where(F.col("below") < half)
           .groupBy("g", "start").agg(F.max("cell").alias("last")))
    kept = salted_join(near, cut, ["g", "start"], "inner", ["k2"], salts).where(
        "cell <= last").select("g", "start", *STATS)
    return _moments(kept, ["g", "start"])


def _sizes(rows: DataFrame) -> DataFrame:
    return settled(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")))


def minimum_covariance(rows: DataFrame, steps: int = STEPS, salts: int = SALTS) -> DataFrame:
    """The estimate of least determinant per group ``g`` of ``rows`` (``g``, ``k2``, the ``STATS``)."""
    est, sizes = settled(_starts(rows)), _sizes(rows)
    for _ in range(steps):
        est = settled(_cholesky(_step(rows, est, sizes, salts)))
    best = est.groupBy("g").agg(F.min(F.struct("logdet", "start")).alias("b"))
    return est.join(best, "g").where("start = b.start").drop("b", "start")


def group_estimates(rows: DataFrame, pooled: DataFrame, steps: int = STEPS,
                    salts: int = SALTS) -> DataFrame:
    """Estimates per ``g``, started from and drawn towards that of the language ``gl`` (``pooled``).

    The language counts as ``PRIOR`` documents in every step, so the half is the one that goes best with
    it.  A group of a few documents has hardly a half of its own; one of thousands is hardly moved.
    """
    names = [f"mu{i}" for i in range(DIM)] + [f"s{i}{j}" for i in range(DIM) for j in range(i + 1)]
    other = settled(rows.groupBy("g").agg(F.first("gl").alias("gl")).join(
        pooled.select("gl", *[F.col(n).alias(f"p_{n}") for n in names]), "gl").drop("gl"))
    start = _cholesky(other.select("g", F.lit(0).alias("start"), *[
        F.col(f"p_{n}").alias(n) for n in names]))
    est, sizes = settled(start), _sizes(rows)
    share = F.col("m") / (F.col("m") + PRIOR)
    for _ in range(steps):
        own = _step(rows, est, sizes, salts).join(other, "g")
        est = settled(_cholesky(own.select("g", "start", *[
            (share * F.col(n) + (1 - share) * F.col(f"p_{n}")).alias(n) for n in names])))
    return est.drop("start")


def _chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution function, by its power series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > 1e-16 * total:
        term *= z / (a + n)
        total += term
        n += 1
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < p else (low, mid)
    return low


def consistency() -> float:
    """What the covariance of the nearest half is multiplied with to estimate the whole's."""
    return 0.5 / _chi2_cdf(chi2_quantile(0.5, DIM), DIM + 2)


def verdicts(docs: DataFrame, reject_p: float = REJECT_P, salts: int = SALTS) -> DataFrame:
    """One row per document: its key, ``doc_id``, the counts, ``base_failed``, distance and ``kept``."""
    df = pack_row(docs)
    doc_id, text = field(df, "doc_id", "long"), field(df, "text", "string")
    lang, source = field(df, "lang", "string"), field(df, "source", "string")
    df = with_counts(df.select(
        doc_id.alias("doc_id"), id_key(doc_id).alias("k1"), digest(lang, source, text).alias("k2"),
        digest(lang, source).alias("g"), digest(lang).alias("gl"), text.alias("__t")), F.col("__t")).drop("__t")
    df = settled(df.withColumns(dict(zip(STATS, _vector(F.col("__n_lines"))))).drop("__n_lines"))
    rows = df.where(~F.col("base_failed"))
    pooled = minimum_covariance(rows.select(F.col("gl").alias("g"), "k2", *STATS), salts=salts)
    est = group_estimates(rows, settled(pooled).withColumnRenamed("g", "gl"), salts=salts)
    limit = chi2_quantile(reject_p, DIM) * consistency()
    judged = _distance(salted_join(df, est, ["g"], "left", ["k2"], salts))
    return judged.select(
        "k1", "k2", "doc_id", *COUNTS, "base_failed",
        F.sqrt(F.col("d2") / consistency()).alias("distance"),
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame, reject_p: float = REJECT_P) -> DataFrame:
    """The documents that pass, with all their columns."""
    bad = verdicts(docs, reject_p).where(~F.col("kept")).select("k1", "k2").distinct()
    df = pack_row(docs)
    lang, source = field(df, "lang", "string"), field(df, "source", "string")
    df = df.withColumn("k1", id_key(field(df, "doc_id", "long"))).withColumn(
        "k2", digest(lang, source, field(df, "text", "string")))
    return unpack_row(df.join(bad, ["k1", "k2"], "left_anti").select(ROW))
