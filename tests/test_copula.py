"""The copula against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import copula as Q
from sigloom.operators.normality import normal_quantile

FEATURES = ["a", "b", "c"]
TRUE = np.array([[1, 0.7, -0.3], [0.7, 1, 0.2], [-0.3, 0.2, 1]])


@pytest.fixture(scope="module")
def planted(spark):
    """Two groups; b is rounded so that a third of its rows are equal, and "flat" does not vary in c."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 3)) @ np.linalg.cholesky(TRUE).T
    y = rng.normal(size=(200, 3))
    x[:, 1] = np.where(np.abs(x[:, 1]) < 0.4, 0.0, x[:, 1])
    y[:, 2] = 3.0
    rows = [("planted", i, *map(float, r)) for i, r in enumerate(x)] + [("flat", i, *map(float, r)) for i, r in enumerate(y)]
    rows += [("few", i, 1.0 * i, 2.0, 3.0 * i) for i in range(7)] + [(None, 1, 1.0, 1.0, 1.0), ("flat", 900, None, 1.0, 3.0), ("flat", 901, float("nan"), 1.0, 3.0), ("flat", 902, float("inf"), 1.0, 3.0)]
    return {"planted": x, "flat": y}, spark.createDataFrame(rows, "g string, count long, a double, b double, c double").repartition(4)


def plain_scores(x):
    out = np.empty_like(x)
    for j in range(x.shape[1]):
        v = x[:, j]
        rank = np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
        out[:, j] = normal_quantile(np.clip((rank - 0.5) / len(v), 1e-4, 1 - 1e-4))
    return out


def test_scores_and_matrices(planted):
    data, df = planted
    scores = Q.normal_scores(df, FEATURES, ["g"])
    told = scores.collect()
    for g, x in data.items():
        got = np.array([[r[f"score_{c}"] for c in FEATURES] for r in sorted((r for r in told if r.g == g), key=lambda r: r["count"])])
        assert np.abs(got - plain_scores(x)).max() < 1e-9
    assert {r.g for r in told} == {"planted", "flat", "few"} and len(told) == 1707
    fits = {r.g: r for r in Q.fit(scores, FEATURES, ["g"]).collect()}
    assert set(fits) == {"planted", "flat"}  # seven rows are too few
    raw = np.corrcoef(plain_scores(data["planted"]), rowvar=False)
    assert np.abs(np.array(fits["planted"].raw).reshape(3, 3) - raw).max() < 1e-9
    settled = np.array(fits["planted"].correlation).reshape(3, 3)
    assert np.abs(settled - (0.9 * raw + 0.1 * np.eye(3))).max() < 1e-9 and np.abs(raw - TRUE).max() < 0.08
    assert fits["flat"].raw[2] == fits["flat"].raw[5] == 0.0 and fits["flat"].raw[8] == 1.0


def test_monotone_transforms_change_nothing(planted):
    _, df = planted
    bent = df.withColumns({"a": F.exp("a"), "b": F.pow("b", F.lit(3.0)), "c": 5 * F.col("c") - 2})
    one, two = ({(r.g, r.a, r.b): r.correlation for r in Q.pairs(Q.fit(Q.normal_scores(d, FEATURES, ["g"]), FEATURES, ["g"]), FEATURES, ["g"]).collect()} for d in (df, bent))
    assert one.keys() == two.keys() and len(one) == 6 and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_conditionals_are_the_solved_ones(planted):
    data, df = planted
    scores = Q.normal_scores(df, FEATURES, ["g"])
    fitted = Q.fit(scores, FEATURES, ["g"])
    c = np.array(next(r.correlation for r in fitted.collect() if r.g == "planted")).reshape(3, 3)
    w = np.linalg.solve(c[np.ix_([0, 2], [0, 2])], c[1, [0, 2]])
    sd = np.sqrt(1 - c[1, [0, 2]] @ w)
    z = plain_scores(data["planted"])
    got = {r["count"]: r for r in Q.conditional_scores(scores, fitted, FEATURES, "b", ["g"]).where("g = 'planted'").collect()}
    assert len(got) == 1500
    for i in (0, 7, 1499):
        assert abs(got[i].expected - z[i, [0, 2]] @ w) < 1e-9 and abs(got[i].sd - sd) < 1e-12 and abs(got[i].residual - (z[i, 1] - z[i, [0, 2]] @ w) / sd) < 1e-8


def test_a_singular_matrix_is_settled():
    c = Q.settled(np.array([[1.0, 1.0], [1.0, 1.0]]), shrink=0.0)
    assert np.linalg.eigvalsh(c).min() > 0 and abs(c[0, 0] - 1) < 1e-12


def test_without_groups_and_quantiles(planted):
    data, df = planted
    only = df.where("g = 'planted'")
    assert Q.fit(Q.normal_scores(only, FEATURES, []), FEATURES, []).first().n == 1500
    assert Q.fit(Q.normal_scores(only.limit(0), FEATURES, []), FEATURES, []).collect() == []
    p = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = {(r.g, r.feature, r.p): r.quantile for r in Q.feature_quantiles(df, FEATURES, ["g"], p).collect()}
    for g, x in data.items():
        for j, c in enumerate(FEATURES):
            assert np.allclose([got[(g, c, q)] for q in p], np.quantile(x[:, j], p), atol=1e-12)
