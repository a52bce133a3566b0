"""The nested index against all pairs, exact quantiles without a gathered group, and the work that the index saves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import expr as X
from sigloom.operators import coverage as C

FEATURES = ["x", "y", "z"]
SCALES = {"x": 1.0, "y": 2.0, "z": 0.5}
WEIGHTS = {"x": 1.0, "y": 0.5, "z": 2.0}


def brute(queries, reference, itself=False):
    """{(id, class): (nearest, distance)} by all pairs, ties to the lesser id."""
    out = {}
    fine = lambda r: r[0] is not None and all(v is not None and np.isfinite(v) for v in r[2:])
    for q in filter(fine, queries):
        for r in filter(fine, reference):
            if r[1] is None or (itself and (r[1] != q[1] or r[0] == q[0])):
                continue
            d = sum(WEIGHTS[f] * ((a - b) / SCALES[f]) ** 2 for f, a, b in zip(FEATURES, q[2:], r[2:]))
            at = (q[0], r[1])
            if at not in out or (d, r[0]) < out[at]:
                out[at] = (d, r[0])
    return {k: (n, round(d**0.5, 9)) for k, (d, n) in out.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, c string, x double, y double, z double")


def found(df):
    return {(r.k, r["class"]): (r.nearest, round(r.distance, 9)) for r in df.collect()}


def cloud(rng, n, first=0):
    """Blobs of unlike width, ties on a lattice, copies, outliers, and rows that take no part."""
    rows = [(first + i, "ab"[i % 2], *map(float, rng.normal(size=3) * 10.0 ** rng.integers(-4, 2))) for i in range(n)]
    rows += [(first + 1000 + i, "abc"[i % 3], float(i % 4), float(i // 4 % 4), -0.0 if i % 5 else 0.0) for i in range(96)]
    rows += [(first + 2000 + i, "a", 0.5, 0.5, 0.5) for i in range(40)] + [(first + 3000, "a", 1e12, -1e12, 0.0), (first + 3001, "b", 3e9, 1.0, 1.0), (first + 3002, "alone", 1.0, 1.0, 1.0)]
    return rows + [(first + 4000, None, 0.0, 0.0, 0.0), (None, "a", 0.0, 0.0, 0.0), (first + 4001, "a", None, 0.0, 0.0), (first + 4002, "a", float("nan"), 0.0, 0.0), (first + 4003, "b", float("inf"), 0.0, 0.0)]


@pytest.mark.parametrize("leaf", [1, 7])
def test_nearest_equals_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(C, "LEAF", leaf)
    rng = np.random.default_rng(2)
    ref, asked = cloud(rng, 300), cloud(rng, 60, first=100)
    got = found(C.nearest(frame(spark, asked), frame(spark, ref), "k", FEATURES, SCALES, "c", WEIGHTS))
    assert got == brute(asked, ref)
    own = found(C.nearest(frame(spark, ref), frame(spark, ref), "k", FEATURES, SCALES, "c", WEIGHTS, among_itself=True))
    assert own == brute(ref, ref, itself=True)
    assert (3002, "alone") not in own and own[2000, "a"] == (2001, 0.0) and own[2001, "a"] == (2000, 0.0)


def test_few_rows_one_feature_and_empty_tables(spark):
    df = frame(spark, [(1, "a", 0.0, 0.0, 0.0), (2, "a", 1.0, 0.0, 0.0), (2, "a", 1.0, 0.0, 0.0)])
    got = C.nearest(df, df, "k", ["x"], {"x": 1.0}, "c", among_itself=True).collect()
    assert sorted((r.k, r.nearest, r.distance) for r in got) == [(1, 2, 1.0), (2, 1, 1.0), (2, 1, 1.0)]
    none = df.limit(0)
    assert C.nearest(none, df, "k", FEATURES, SCALES, "c").collect() == C.nearest(df, none, "k", FEATURES, SCALES, "c").collect() == []
    assert C.thresholds(none, "k", FEATURES, SCALES, "c").collect() == []
    assert C.coverage_rates(spark.createDataFrame([], "k long, class string, covered boolean"), "k").collect() == []
    with pytest.raises(ValueError):
        C.robust_scales(none, FEATURES)


def test_index_measures_a_small_share(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "a", *map(float, rng.normal(size=3))) for i in range(6000)]
    rows += [(6000 + i, "a", *map(float, 50 + 1e-3 * rng.normal(size=3))) for i in range(3000)]  # a third in one spot
    df = frame(spark, rows)
    got = C.nearest(df, df, "k", FEATURES, SCALES, "c", among_itself=True)
    work, n = got.agg(F.sum("compared"), F.count("*")).first()
    assert n == 9000 and work < 0.1 * 9000 * 9000


def test_what_is_written_grows_with_the_answers(spark, monkeypatch):
    """Cells and points that a query is measured against stay in the task."""
    written = []
    table = C.Staging.table

    def counted(self, df, keep=False):
        out = table(self, df, keep)
        written.append(out.count())
        return out

    monkeypatch.setattr(C.Staging, "table", counted)
    rng = np.random.default_rng(4)
    ref, asked = ([(i, "ab"[i % 2], *map(float, rng.normal(size=3))) for i in range(n)] for n in (3000, 1000))
    got = C.nearest(frame(spark, asked), frame(spark, ref), "k", FEATURES, SCALES, "c", WEIGHTS)
    assert got.count() == 2000 and sum(written) < 4 * (2000 + 3000 + 1000)


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 4001])
def test_quantiles_are_the_interpolated_ones(spark, n):
    rng = np.random.default_rng(n)
    data = {"u": rng.normal(size=n), "v": rng.integers(0, 9, n).astype(float), "w": np.exp(3 * rng.normal(size=n))}
    df = spark.createDataFrame([(g, float(x)) for g, a in data.items() for x in a] + [("u", None)], "g string, x double").repartition(5)
    for q in (0.0, 0.25, 0.5, 0.95, 0.999, 1.0):
        got = {r.g: (r.n, r.quantile) for r in C.exact_quantile(df, ["g"], "x", q).collect()}
        for g, a in data.items():
            assert got[g][0] == n and abs(got[g][1] - np.quantile(a, q)) <= 1e-12 * max(1, abs(got[g][1])), (g, q)


def test_equal_profiles_tie_whatever_the_order_of_their_rows(spark, tmp_path):
    """Customers with the same orders, met in another order, have the same mean to the bit, so that ties go to the lesser key."""
    prices = [0.1, 0.2, 0.3, 1e5 + 0.07, 33.33]
    orders = [(c, s, p) for s in "FO" for c in range(40) for p in (prices[c % 5 :] + prices[: c % 5])]
    spark.createDataFrame([(c, "s", 1.0) for c in range(40)], "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_custkey long, o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    from sigloom.plans.models import class_nearest

    got = class_nearest(spark, str(tmp_path)).collect()
    assert len(got) == 40 and {r.nearest for r in got} == {0} and {r.covered for r in got} == {True}


def test_steady_mean_of_odd_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", float("nan")), ("b", 1.0), ("c", None), ("d", 1e300), ("d", 2e300)], "g string, x double")
    got = {r.g: r.m for r in df.groupBy("g").agg(X.steady_mean(F.col("x")).alias("m")).collect()}
    assert got["a"] == 1.0 and np.isnan(got["b"]) and got["c"] is None and abs(got["d"] / 1.5e300 - 1) < 1e-12
