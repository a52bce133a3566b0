import itertools

import numpy as np
from pyspark.sql import functions as F

from sigloom.operators import matching as M
from sigloom.operators import stats as T


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (3, 3), (2, 4), (5, 3), (6, 6)]:
        for _ in range(20):
            u = rng.random((n, m)) * (rng.random((n, m)) > 0.3)
            got = sum(u[i, j] for i, j in M.assign(u))
            big = np.zeros((max(n, m),) * 2)
            big[:n, :m] = u
            best = max(sum(big[i, p[i]] for i in range(len(big))) for p in itertools.permutations(range(len(big))))
            assert abs(got - best) < 1e-9
    assert M.assign(np.zeros((0, 3))) == []


def test_optimal_match_keeps_identity(spark):
    a = spark.createDataFrame([(1, 5, 0.0, 10.0), (1, 6, 8.0, 30.0)], "k int, id int, start double, end double")
    b = spark.createDataFrame([(1, 2, 9.0, 31.0), (1, 3, 1.0, 10.0)], a.schema)
    out = sorted(M.optimal_match(a, b, ["k"], "id").collect())
    assert [(r.l_key, r.r_key) for r in out] == [(5, 3), (6, 2)] and abs(out[0].iou - 0.9) < 1e-9


def test_greedy_match_is_one_to_one(spark):
    a = spark.createDataFrame([(1, 0, 10.0), (1, 1, 12.0)], "k int, id int, at double")
    b = spark.createDataFrame([(1, 7, 11.5), (1, 8, 30.0)], a.schema)
    assert [(r.l_key, r.r_key) for r in M.greedy_match(a, b, ["k"], "at", "id", 5.0).collect()] == [(1, 7)]


def test_suppression(spark):
    rows = [(1, 0, 0.0, 10.0, 1.0), (1, 1, 1.0, 11.0, 8.0), (1, 2, 50.0, 60.0, 2.0)]
    out = {r.id: r.kept_by for r in M.suppress(spark.createDataFrame(rows, "k int, id int, start double, end double, snr double"), ["k"], "id", "snr", 0.5).collect()}
    assert out == {0: 1, 1: None, 2: None}


def test_drifting_dedup(spark):
    rows = [(1, 0, 100.0, 0.0, 1.0), (1, 1, 150.0, 0.1, 5.0), (1, 2, 220.0, 0.0, 2.0), (1, 3, 900.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, id int, f double, t double, e double")
    # 1 replaces 0, and 2 is close to 1 though not to 0
    assert sorted(r.id for r in M.drifting_dedup(df, ["k"], "id", "f", "t", "e", 90.0, 1.0).collect()) == [1, 3]


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([("a", *p) for p in zip([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [9.0, 7.0, 8.0, 3.0, 2.0, 1.0])] + [("b", float(x), float(y)) for x, y in zip([3, 1, 1, 1, 2, 7, 7], [2, 2, 5, 1, 9, 9, 2])], "g string, x double, y double")
    out = {r.g: r.rho for r in T.spearman(df, ["g"], "x", "y").collect()}
    rank = lambda v: np.array([np.sum(np.array(v) < x) + (np.sum(np.array(v) == x) + 1) / 2 for x in v])
    assert abs(out["a"] + 33 / 35) < 1e-12 and abs(out["b"] - np.corrcoef(rank([3, 1, 1, 1, 2, 7, 7]), rank([2, 2, 5, 1, 9, 9, 2]))[0, 1]) < 1e-12


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 0.0, 0.2), (1, 2.0, 0.6), (1, 4.0, 0.7), (1, 8.0, 0.9)], "g int, x double, y double")
    assert abs(T.first_crossing(df, ["g"], "x", "y", 0.4).first().threshold - 1.0) < 1e-9
    assert T.first_crossing(df, ["g"], "x", "y", 1.01).first().threshold is None
    assert T.sustained_crossing(df, ["g"], "x", "y", 0.6).first().threshold == 2.0


def test_bootstrap_holds_the_mean(spark):
    df = spark.range(400).select(F.lit(1).alias("g"), (F.col("id") % 40).alias("c"), (F.col("id") % 7).cast("double").alias("v"))
    r = T.cluster_bootstrap(df, ["g"], "c", "v", 200, 3).first()
    assert r.low < r.mean < r.high


def test_positive_definite():
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]])
    fixed = T.positive_definite(bad)
    assert np.linalg.eigvalsh(fixed)[0] > 0 and np.allclose(np.diag(fixed), 1)


def test_islands_give_what_whole_keys_give(spark):
    """Suppression, dedup and assignment by islands, against the same rules over a key at once."""
    rng = np.random.default_rng(8)
    start = rng.integers(0, 3000, 120).astype(float)
    rows = [(1, i, float(a), float(a + rng.integers(1, 60)), float(rng.integers(0, 9)), float(rng.integers(0, 40))) for i, a in enumerate(start)]
    df = spark.createDataFrame(rows, "k int, id int, start double, end double, score double, f double")
    kept, by = [], {}
    for _, i, s, e, *_ in sorted(rows, key=lambda r: (-r[4], r[1])):
        v = [max(0.0, min(e, y) - max(s, x)) / (max(e, y) - min(s, x)) for _, x, y in kept]
        if v and max(v) >= 0.2:
            by[i] = kept[int(np.argmax(v))][0]
        else:
            kept.append((i, s, e))
    got = {r.id: r.kept_by for r in M.suppress(df, ["k"], "id", "score", 0.2).collect()}
    assert {i: b for i, b in got.items() if b is not None} == by
    reps = []
    for r in rows:
        n = next((n for n, q in enumerate(reps) if abs(r[5] - q[5]) < 10 and abs(r[2] - q[2]) < 25), None)
        if n is None:
            reps.append(r)
        elif r[4] > reps[n][4]:
            reps[n] = r
    assert sorted(r.id for r in M.drifting_dedup(df, ["k"], "id", "f", "start", "score", 10.0, 25.0).collect()) == sorted(r[1] for r in reps)
    a, b = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    (s, e), (t, f) = (np.array([(r[2], r[3]) for r in rows if r[1] % 2 == side]).T for side in (0, 1))
    inter = np.clip(np.minimum(e[:, None], f) - np.maximum(s[:, None], t), 0, None)
    iou = inter / (np.maximum(e[:, None], f) - np.minimum(s[:, None], t))
    delta = np.abs((s + e)[:, None] / 2 - (t + f) / 2)
    best = M.assign(np.where((iou > 0) | (delta <= 30), 1000 + iou - 1e-7 * delta, 0.0))
    out = M.optimal_match(a, b, ["k"], "id", 30.0).collect()
    assert len(out) == len(best) and abs(sum(r.iou for r in out) - sum(iou[p] for p in best)) < 1e-3


def test_within_refuses_what_it_cant_tell(spark):
    import pytest

    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, x double")
    with pytest.raises(ValueError):
        M.within(df, df, ["k"], "x", 1.0, "full")
    assert M.within(df, df, ["k"], "x", 0.0).count() == 2
