"""Folds of whole groups, Newton by sums against plain descent, and scores against counts written out."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import discrimination as D
from sigloom.operators import resampling as R


def data(spark, n=900, groups=40, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.choice(3, p=[0.6, 0.3, 0.1]))
        rows.append((int(rng.integers(groups)) if y != 2 else int(rng.integers(groups // 2)), "abc"[y], *map(float, rng.normal(size=2) + [1.5 * y, -y]), float(rng.normal())))
    return rows, spark.createDataFrame(rows, "grp long, label string, x double, y double, z double").repartition(4)


def plain_loss(t, x, y, k, penalty=1.0):
    """The loss row by row, classes weighing alike."""
    c = np.bincount(y, minlength=k)
    out = 0.5 * penalty * float((t[:, :-1] ** 2).sum())
    for row, label in zip(x, y):
        z = t[:, :-1] @ row + t[:, -1]
        out += len(y) / k / c[label] * (np.log(np.exp(z).sum()) - z[label])
    return out


def test_whole_groups_in_even_folds(spark):
    rows, df = data(spark)
    fold = {r.grp: r.fold for r in D.group_folds(df, "grp", "label", 5).collect()}
    assert set(fold) == {r[0] for r in rows} and set(fold.values()) == set(range(5))
    sizes = Counter(fold[r[0]] for r in rows)
    assert max(sizes.values()) < 1.25 * min(sizes.values())
    odd = spark.createDataFrame([(None, "a"), (1, None), (2, "a"), (2, "b"), (3, "b")], "grp long, label string")
    assert {r.grp for r in D.group_folds(odd, "grp", "label", 2).collect()} == {2, 3}
    assert D.group_folds(odd.limit(0), "grp", "label").collect() == []


def test_newton_by_sums_ends_where_the_plain_loss_is_least(spark):
    rows, df = data(spark, 300)
    kinds = ["a", "b", "c"]
    prepared = D._prepared(df, D.group_folds(df, "grp", "label", 3), "grp", "label", ["x", "y", "z"], kinds).cache()
    models, center, scale = D.train(prepared, [[0], [0, 1, 2]], [None, 1], 3, 3)
    local = prepared.toPandas()
    for m in models:
        mine = local if m.out is None else local[local.fold != m.out]
        raw = mine[["x0", "x1", "x2"]].to_numpy()
        at = 0 if m.out is None else 1
        assert np.allclose(center[at], np.percentile(raw, 50, axis=0, method="inverted_cdf"))
        x = ((raw - center[at]) / scale[at])[:, m.columns]
        loss = lambda t: plain_loss(t, x, mine.y.to_numpy(), 3)
        assert m.done and abs(loss(m.theta) - m.loss) < 1e-6
        # the loss is convex: no slope in any direction is the least of all
        for i in range(m.theta.size):
            e = np.zeros(m.theta.size)
            e[i] = 1e-4
            e = e.reshape(m.theta.shape)
            up, down = loss(m.theta + e), loss(m.theta - e)
            assert abs(up - down) / 2e-4 < 1e-5 and min(up, down) > loss(m.theta) - 1e-9


def test_predictions_come_from_models_without_the_group(spark):
    rows, df = data(spark)
    sets = {"x": ["x"], "z": ["z"], "all": ["x", "y", "z"]}
    told = D.held_out_predictions(df, "grp", "label", ["x", "y", "z"], sets, folds=4)
    got = told.collect()
    assert Counter(r.contract for r in got) == {c: len(rows) for c in sets}
    assert len({(r.grp, r.fold) for r in got}) == len({r[0] for r in rows})
    score = {(r.contract, r.score): r for r in D.contract_scores(told, "grp", 40, 1).collect()}
    for c in sets:
        mine = [r for r in got if r.contract == c]
        recall = [np.mean([r.predicted == k for r in mine if r.truth == k]) for k in "abc"]
        f1 = [2 * sum(r.truth == r.predicted == k for r in mine) / sum((r.truth == k) + (r.predicted == k) for r in mine) for k in "abc"]
        assert abs(score[c, "macro_f1"].estimate - np.mean(f1)) < 1e-12 and abs(score[c, "balanced_accuracy"].estimate - np.mean(recall)) < 1e-12
        assert score[c, "macro_f1"].low <= np.mean(f1) <= score[c, "macro_f1"].high and score[c, "macro_f1"].replicates == 40
    assert score["all", "balanced_accuracy"].estimate > 0.7 > 0.45 > score["z", "balanced_accuracy"].estimate
    # one replicate, its groups written out
    keys = df.select("grp").distinct().select("grp", *R._keys([["grp"]])).toPandas()
    w = dict(zip(keys.grp, R.weights([keys._k0.to_numpy()], 40, 1)[:, 7]))
    cells = R.replicate_sums(told.where("contract = 'all'").groupBy("grp", "contract", "truth", "predicted").agg(F.count(F.lit(1)).alias("c")), ["contract", "truth", "predicted"], [["grp"]], {"hits": F.col("c")}, 40, 1)
    for r in cells.where("replicate = 7").collect():
        assert r.hits == sum(w[q.grp] for q in got if q.contract == "all" and (q.truth, q.predicted) == (r.truth, r.predicted))


def test_one_class_odd_values_and_empty_tables(spark):
    _, df = data(spark, 60)
    odd = df.withColumn("x", F.when(F.col("grp") % 3 == 0, float("nan")).when(F.col("grp") % 3 == 1, None).otherwise(F.col("x")))
    got = D.held_out_predictions(odd, "grp", "label", ["x"], {"x": ["x"]}, folds=2).collect()
    assert {r.grp % 3 for r in got} == {2}
    for none in (df.where("label = 'a'"), df.limit(0), df.withColumn("x", F.lit(None).cast("double"))):
        out = D.held_out_predictions(none, "grp", "label", ["x"], {"x": ["x"]}, folds=2)
        assert out.collect() == [] and D.contract_scores(out, "grp", 5).collect() == []
    flat = D.held_out_predictions(df.withColumn("x", F.lit(1.0)), "grp", "label", ["x"], {"x": ["x"]}, folds=2)
    assert flat.count() == 60


def test_folds_are_worked_out_once(spark):
    """Steps and predictions read the dealt folds; the groups are not counted anew in each."""
    df = spark.createDataFrame([(i % 20, "ab"[(i * 7 + i // 20) % 2], float(i % 13)) for i in range(400)], "g long, c string, x double")
    told = D.held_out_predictions(df, "g", "c", ["x"], {"x": ["x"]})
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert told.count() == 400 and "Aggregate" not in plan and "Window" not in plan
