"""Moments of arrays: a row's mean is worked out once, whatever its length."""

import time

import numpy as np
from pyspark.sql import functions as F

from sigloom.functions import expr as X


def test_z_scores_and_deviation_equal_numpy(spark):
    a = np.random.default_rng(0).normal(3, 2, 50)
    df = spark.createDataFrame([(1, a.tolist()), (2, [4.0, 4.0]), (3, []), (4, None)], "k int, a array<double>")
    got = {r.k: r for r in df.select("k", X.z_scored(F.col("a")).alias("z"), X.array_std(F.col("a")).alias("s")).collect()}
    assert np.allclose(got[1].z, (a - a.mean()) / a.std(), rtol=0, atol=1e-12) and abs(got[1].s - a.std()) < 1e-12
    assert (got[2].z, got[2].s) == (None, 0.0) and (got[3].z, got[3].s) == (None, None) and (got[4].z, got[4].s) == (None, None)


def test_z_scores_of_a_long_array_take_one_pass(spark):
    # with a mean for each element of each deviation this is 1.25e11 steps
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: i.cast("double")).alias("a"))
    t = time.monotonic()
    z = df.select(X.z_scored(F.col("a")).alias("z")).first().z
    assert len(z) == 5000 and abs(sum(z)) < 1e-6 and time.monotonic() - t < 20
