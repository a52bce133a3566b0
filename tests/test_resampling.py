"""Replicates against the statistic on rows written out as often as they weigh."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import resampling as R
from sigloom.operators.staging import Staging


def sample(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = float(rng.integers(0, 12))  # ties
        rows.append(("ab"[i % 2], f"s{rng.integers(9)}", i, x, float(x + rng.normal() * 4), float(rng.normal())))
    return rows, spark.createDataFrame(rows, "g string, source string, event long, x double, y double, z double").repartition(3)


def drawn(df, levels, replicates, seed):
    """{event: weights} by the operator's own draws."""
    t = df.select("event", *R._keys(levels)).toPandas()
    w = R.weights([t[f"_k{i}"].to_numpy() for i in range(len(levels))], replicates, seed)
    return {int(e): w[i].astype(int) for i, e in enumerate(t["event"])}


def ranks(v):
    return np.array([(np.sum(v < x) + (np.sum(v == x) + 1) / 2) for x in v])


def test_draws_are_poisson_and_the_same_for_a_unit():
    keys = np.arange(4000, dtype=np.int64) * 7919
    w = R.weights([keys], 50, 3)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.03
    assert abs(np.mean(w[:, 1:] == 0) - np.exp(-1)) < 0.01
    assert (R.weights([keys[::-1]], 50, 3)[::-1] == w).all() and (R.weights([keys], 20, 3) == w[:, :21]).all()
    assert not (R.weights([keys], 50, 4) == w).all()
    assert np.corrcoef(w[:, 1:].T)[np.triu_indices(50, 1)].max() < 0.1  # replicates do not follow each other


@pytest.mark.parametrize("levels", [[["source"]], [["source"], ["event"]]])
def test_means_equal_those_of_rows_written_out(spark, levels):
    rows, df = sample(spark)
    w = drawn(df, levels, 30, 5)
    got = {(r.g, r.replicate): r.total / r.weight for r in R.replicate_sums(df, ["g"], levels, {"total": F.col("y")}, 30, 5).collect()}
    for g in "ab":
        for k in range(31):
            out = np.repeat([r[4] for r in rows if r[0] == g], [w[r[2]][k] for r in rows if r[0] == g])
            assert abs(got[g, k] - out.mean()) < 1e-9
    told = {r.g: r for r in R.bootstrap_means(df, ["g"], levels, "y", 30, 5).collect()}
    draws = [got["a", k] for k in range(1, 31)]
    assert abs(told["a"].estimate - got["a", 0]) < 1e-12 and abs(told["a"].low - np.percentile(draws, 2.5)) < 1e-9 and told["a"].replicates == 30


@pytest.mark.parametrize("range_rows", [10_000, 37])
def test_rank_correlations_equal_those_of_rows_written_out(spark, range_rows):
    rows, df = sample(spark, 240)
    levels, k = [["source"], ["event"]], 12
    w = drawn(df, levels, k, 2)
    with Staging(spark, "test") as st:
        sums = R.replicate_rank_sums(st, df, ["g"], levels, ["x", "y", "z"], k, 2, range_rows).collect()
    rho = {g: [None] * (k + 1) for g in "ab"}
    for r in sums:
        times = [w[q[2]][r.replicate] for q in rows if q[0] == r.g]
        cols = [ranks(np.repeat([q[c] for q in rows if q[0] == r.g], times)) for c in (3, 4, 5)]
        p = np.array([[r["s%d_%d" % (min(i, j), max(i, j))] for j in range(3)] for i in range(3)])
        c, partial = R.correlations(r.n, np.array([r.s0, r.s1, r.s2]), p)
        assert r.n == sum(times) and np.abs(c - np.corrcoef(cols)).max() < 1e-9
        # a partial correlation is that of what is left of both after the third is fitted
        left = [a - np.polyval(np.polyfit(cols[2], a, 1), cols[2]) for a in cols[:2]]
        assert abs(partial[0, 1] - np.corrcoef(left)[0, 1]) < 1e-9
        rho[r.g][r.replicate] = c[0, 1]
    told = {(r.g, r.x, r.y): r for r in R.bootstrap_spearman(df, ["g"], levels, ["x", "y", "z"], k, 2, range_rows=range_rows).collect()}
    assert len(told) == 6
    one = told["a", "x", "y"]
    assert abs(one.rho - rho["a"][0]) < 1e-9 and abs(one.low - np.percentile(rho["a"][1:], 2.5)) < 1e-9 and one.replicates == k and one.n == 120


def test_constant_columns_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("c", 1, 1.0, float(i)) for i in range(9)] + [("few", 1, 1.0, 2.0), ("few", 2, 3.0, None), ("odd", 3, float("nan"), 1.0)], "g string, s int, x double, y double")
    got = {r.g: r for r in R.bootstrap_spearman(df, ["g"], [["s"]], ["x", "y"], 5).collect()}
    assert set(got) == {"c", "few"} and all(r.rho is None and r.low is None and r.replicates == 0 for r in got.values())
    whole = R.bootstrap_spearman(df.where("g = 'c'").withColumn("x", F.col("y") * F.col("y")), [], [["y"]], ["x", "y"], 5).collect()
    assert len(whole) == 1 and abs(whole[0].rho - 1) < 1e-12
    none = df.limit(0)
    assert R.bootstrap_spearman(none, ["g"], [["s"]], ["x", "y"], 5).collect() == R.bootstrap_means(none, ["g"], [["s"]], "x", 5).collect() == []
    with pytest.raises(ValueError):
        R.replicate_sums(df, [], [], {}, 5)
