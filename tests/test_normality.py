"""Tests of normality against published values and plain sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import normality as N


def test_quantiles_and_tails():
    # known values of the distributions
    assert np.abs(N.normal_quantile(np.array([0.975, 0.5, 0.025, 1e-9, 0.8413447460685429])) - [1.959963984540054, 0, -1.959963984540054, -5.997807015007686, 1.0]).max() < 1e-12
    for f, a, b, p in [(4.9646027437307145, 1, 10, 0.05), (3.3258345304130117, 4, 10, 0.056094), (1.0, 7, 7, 0.5)]:
        assert abs(N.f_tail(f, a, b) - p) < 6e-3
    assert abs(N.f_tail(4.9646027437307145, 1, 10) - 0.05) < 1e-12 and abs(N.f_tail(1.0, 7, 7) - 0.5) < 1e-14
    assert abs(N.f_tail(3.0, 2, 8) - (1 + 2 * 3.0 / 8) ** -4) < 1e-14  # closed form for two


def test_published_example_of_order_statistics():
    # weights of eleven men, Shapiro and Wilk 1965: W = 0.79, p = 0.0067
    w, p = N.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert abs(w - 0.78881) < 2e-5 and abs(p - 0.006704) < 2e-5
    assert N.shapiro_wilk(np.array([1.0, 1.0, 1.0])) is None and N.shapiro_wilk(np.array([1.0, 2.0])) is None
    w3, p3 = N.shapiro_wilk(np.array([0.0, 1.0, 2.0]))
    assert abs(w3 - 1) < 1e-12 and abs(p3 - 1) < 1e-6


def test_published_example_of_moments(spark):
    # 62 cholesterol values, D'Agostino, Belanger and D'Agostino 1990: Z = 3.14 and 2.21, K2 = 14.75
    n, s, k = F.lit(62.0), F.lit(1.02), F.lit(4.58 - 3)
    a, b = spark.range(1).select(N.skewness_z(n, s), N.kurtosis_z(n, k)).first()
    assert abs(a - 3.14) < 0.01 and abs(b - 2.21) < 0.01 and abs(a * a + b * b - 14.75) < 0.1


def test_levels_hold_under_normal_values():
    rng = np.random.default_rng(0)
    p = np.array([N.shapiro_wilk(rng.normal(size=n))[1] for n in (5, 9, 11, 12, 40, 300) for _ in range(300)])
    assert abs((p < 0.05).mean() - 0.05) < 0.02 and abs((p < 0.5).mean() - 0.5) < 0.05
    assert np.mean([N.shapiro_wilk(rng.exponential(size=40))[1] < 0.01 for _ in range(50)]) > 0.9


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(1)
    data = {"normal": rng.normal(size=300), "skewed": rng.exponential(size=300), "big": rng.normal(size=900) + 0.5, "tied": np.ones(20), "two": np.array([1.0, 2.0]), "one": np.array([1.0])}
    rows = [(g, float(v)) for g, a in data.items() for v in a] + [("normal", None), ("normal", float("nan")), ("big", float("inf")), (None, 1.0)]
    return data, spark.createDataFrame(rows, "g string, x double").repartition(4)


def test_groups_get_the_test_of_their_size(spark, groups):
    data, df = groups
    got = {r.g: r for r in N.normality(df, ["g"], "x", most=500).collect()}
    assert {g: r.test for g, r in got.items() if g} == {"normal": "shapiro", "skewed": "shapiro", "big": "dagostino", "tied": "shapiro", "two": "not_enough_samples", "one": "not_enough_samples"}
    assert got["normal"].p > 0.01 > got["skewed"].p and got["big"].p > 0.001 and got["tied"].statistic is None and got["big"].n == 900
    v = data["big"]
    d = v - v.mean()
    m2, m3, m4 = ((d**k).mean() for k in (2, 3, 4))
    n = len(v)
    told = spark.range(1).select(N.skewness_z(F.lit(float(n)), F.lit(float(m3 / m2**1.5))), N.kurtosis_z(F.lit(float(n)), F.lit(float(m4 / m2**2 - 3)))).first()
    assert abs(got["big"].statistic - told[0] ** 2 - told[1] ** 2) < 1e-8 and abs(got["big"].p - math.exp(-got["big"].statistic / 2)) < 1e-12
    assert N.normality(df.limit(0), ["g"], "x").collect() == []


def test_comparison_follows_normality(groups):
    data, df = groups
    both = lambda *names: [d.collect() for d in N.compare_groups(df.where(F.col("g").isin(*names)), "g", "x")]
    overall, pairs = both("normal", "big")
    a, b = data["big"], data["normal"]
    grand = np.r_[a, b].mean()
    f = (len(a) * (a.mean() - grand) ** 2 + len(b) * (b.mean() - grand) ** 2) / ((a.var() * len(a) + b.var() * len(b)) / (len(a) + len(b) - 2))
    assert overall[0].test == "anova" and abs(overall[0].statistic - f) < 1e-9 and overall[0].p < 1e-6
    assert pairs[0].u == sum((x > b).sum() for x in a) and abs(pairs[0].delta - np.median(a) + np.median(b)) < 1e-12
    overall, pairs = both("normal", "skewed", "big", "one")
    assert overall[0].test == "kruskal" and len(pairs) == 3 and all(p.p_bonferroni == min(1.0, 3 * p.p) for p in pairs)
    overall, pairs = both("normal", "one")
    assert overall[0].test == "not_enough_classes" and pairs == []
    overall, pairs = both("tied", "two")
    assert overall[0].test == "kruskal" and pairs[0].p <= 1
