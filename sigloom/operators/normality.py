"""Tests of normality, and the comparison of groups that follows from them.

Groups of up to 5,000 values are tested by order statistics (Shapiro-Wilk, with the approximated weights and the
transformed tail of Royston), which sorts one such group in a task; larger ones by skewness
and kurtosis (D'Agostino-Pearson), whose moments merge and need no sort.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import populations
from .coverage import exact_quantile

MOST = 5000
# fixed values: coefficients of the published approximations, lowest power first
FIRST_WEIGHT = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SECOND_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_SHIFT, SMALL_MEAN, SMALL_SCALE = [-2.273, 0.459], [0.544, -0.39978, 0.025054, -6.714e-4], [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN, LARGE_SCALE = [-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302]


def _poly(c: list[float], x: float) -> float:
    return float(np.polyval(c[::-1], x))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Standard normal quantiles, by Newton's steps on the tail from a rough start (nearer the middle the tail is a half)."""
    tail = np.minimum(p, 1 - p)
    r = np.sqrt(-2 * np.log(tail))
    x = r - (2.515517 + 0.802853 * r + 0.010328 * r * r) / (1 + 1.432788 * r + 0.189269 * r * r + 0.001308 * r**3)
    upper = np.vectorize(lambda z: 0.5 * math.erfc(z / math.sqrt(2)), otypes=[float])
    for _ in range(3):
        step = (upper(x) - tail) / (np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi))
        x = x + step / (1 - 0.5 * x * step)  # with the curvature, so that three steps do
    return np.where(p < 0.5, -x, x)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float] | None:
    """(W, p) of 3 to 5,000 values; None outside, or where all are equal."""
    x = np.sort(values)
    n = len(x)
    if not 3 <= n <= MOST or x[0] == x[-1]:
        return None
    m = normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    square = float(m @ m)
    r = n**-0.5
    a = np.empty(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        ends = [_poly(FIRST_WEIGHT, r) + m[-1] / math.sqrt(square)]
        if n > 5:
            ends.append(_poly(SECOND_WEIGHT, r) + m[-2] / math.sqrt(square))
        k = len(ends)
        rest = (square - 2 * float(m[-k:] @ m[-k:])) / (1 - 2 * sum(e * e for e in ends))
        a[k : n - k] = m[k : n - k] / math.sqrt(rest)
        a[n - k :], a[:k] = ends[::-1], [-e for e in ends]
    d = x - x.mean()
    w = min(1.0, float(a @ d) ** 2 / float(d @ d))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, z = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        shift = _poly(SMALL_SHIFT, n)
        if y >= shift:
            return w, 0.0
        y, mean, scale = -math.log(shift - y), _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_SCALE, n))
    else:
        mean, scale = _poly(LARGE_MEAN, z), math.exp(_poly(LARGE_SCALE, z))
    return w, 0.5 * math.erfc((y - mean) / scale / math.sqrt(2))


def skewness_z(n: Column, skew: Column) -> Column:
    """The skewness of n values as a standard normal; null below 8 values."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w = F.sqrt(2 * (beta - 1)) - 1
    return F.when(n >= 8, F.asinh(y * F.sqrt((w - 1) / 2)) / F.sqrt(0.5 * F.log(w)))


def kurtosis_z(n: Column, excess: Column) -> Column:
    """The excess kurtosis of n values as a standard normal; null below 8 values."""
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(spread)
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + F.sqrt(1 + 4 / (skew * skew)))
    under = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(under) * F.pow(F.try_divide(1 - 2 / a, F.abs(under)), F.lit(1 / 3))
    return F.when(n >= 8, (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a)))


def dagostino(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``(group, n, statistic, p)``: squares of both standard scores, from mergeable moments; null below 8 values or where all are equal."""
    m = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.skewness(value).alias("_s"), F.kurtosis(value).alias("_k"))
    safe = F.greatest(F.col("n"), F.lit(8.0))
    k2 = F.pow(skewness_z(safe, F.col("_s")), F.lit(2.0)) + F.pow(kurtosis_z(safe, F.col("_k")), F.lit(2.0))
    told = m.withColumn("statistic", F.when((F.col("n") >= 8) & ~F.isnan(k2), k2))
    return told.select(*group, F.col("n").cast("long").alias("n"), "statistic", F.exp(-F.col("statistic") / 2).alias("p"))


def normality(df: DataFrame, group: list[str], value: str, most: int = MOST) -> DataFrame:
    """``(group, n, test, statistic, p)``: ``shapiro`` up to ``most`` values, ``dagostino`` beyond, ``not_enough_samples`` below three.

    Nulls and values that are not finite are left out; a group whose values are all equal has a null statistic.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*group, x.alias("_x"))
    sized = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    few, large = (sized.where(F.col("_n") <= most) if small else sized.where(F.col("_n") > most) for small in (True, False))
    kinds = dict(rows.dtypes)

    def run(t: pa.Table) -> pa.Table:
        v = t.column("_x").to_numpy()
        got = shapiro_wilk(v)
        told = {"n": [len(v)], "test": ["shapiro" if len(v) >= 3 else "not_enough_samples"], "statistic": pa.array([got and got[0]], pa.float64()), "p": pa.array([got and got[1]], pa.float64())}
        return pa.table({**{c: t.column(c).slice(0, 1) for c in group}, **told})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in group), "n long, test string, statistic double, p double"])
    by_order = rows.join(few.select(*group), group, "left_semi").groupBy(*group).applyInArrow(run, schema)
    by_moments = dagostino(rows.join(large.select(*group), group, "left_semi"), group, "_x").select(*group, "n", F.lit("dagostino").alias("test"), "statistic", "p")
    return by_order.union(by_moments)


def f_tail(f: float, a: float, b: float) -> float:
    """The probability of an F value above f with a and b degrees of freedom, by the continued fraction of the incomplete beta function."""
    if f <= 0:
        return 1.0
    x, p, q = b / (b + a * f), b / 2, a / 2
    if x > (p + 1) / (p + q + 2):
        return 1 - _beta(1 - x, q, p)
    return _beta(x, p, q)


def _beta(x: float, p: float, q: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x) + q * math.log1p(-x)) / p
    c, d = 1.0, 1 / (1 - (p + q) * x / (p + 1))
    out = d
    for m in range(1, 500):
        for t in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / (1 + t * d), 1 + t / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def compare_groups(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The overall test ``(test, statistic, p)``, and ``(a, b, u, p, p_bonferroni, median_a, median_b, delta)`` for each two groups.

    Groups of fewer than two values are left out. Where every other one passes for normal at ``alpha`` the overall test is
    ``anova``, else ``kruskal``; with fewer than two groups it is ``not_enough_classes`` and there are no pairs. Tails of
    pairs are those of the normal approximation, corrected for ties and continuity. Groups are few: their tests go to the driver.
    """
    spark = df.sparkSession
    x = F.col(value).cast("double")
    rows = df.where(F.col(group).isNotNull() & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(F.col(group).alias("g"), x.alias("x"))
    tests = [r for r in normality(rows, ["g"], "x").collect() if r.n >= 2]
    names = sorted(r.g for r in tests)
    kind = dict(rows.dtypes)["g"]
    pair_schema = f"a {kind}, b {kind}, u double, p double, p_bonferroni double, median_a double, median_b double, delta double"
    if len(names) < 2:
        return spark.createDataFrame([("not_enough_classes", None, None)], "test string, statistic double, p double"), spark.createDataFrame([], pair_schema)
    used = rows.where(F.col("g").isin(names))
    if all((r.p or 0.0) >= alpha for r in tests):
        one = populations.anova(used, "x", "g").first()
        overall = ("anova", one.f, f_tail(one.f, one.df_between, one.df_within) if one.f is not None else None)
    else:
        one = populations.kruskal(used, "x", "g", names).first()
        overall = ("kruskal", one.h, populations.chi2_tail(one.h, one.df) if one.h is not None else None)
    medians = F.create_map(*[F.lit(v) for r in exact_quantile(used, ["g"], "x", 0.5).collect() for v in (r.g, r.quantile)])
    pairs = populations.mann_whitney(used, "x", "g", names).collect()
    tails = {(r.a, r.b): populations.normal_tail(r.z) if r.z is not None else 1.0 for r in pairs}
    made = spark.createDataFrame([(r.a, r.b, float(r.u), tails[r.a, r.b], min(1.0, tails[r.a, r.b] * len(pairs))) for r in pairs], f"a {kind}, b {kind}, u double, p double, p_bonferroni double")
    told = made.withColumn("median_a", medians[F.col("a")]).withColumn("median_b", medians[F.col("b")])
    return spark.createDataFrame([overall], "test string, statistic double, p double"), told.withColumn("delta", F.col("median_a") - F.col("median_b"))
