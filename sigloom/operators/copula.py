"""A Gaussian copula: normal scores from ranks, their correlation, quantiles of each feature, and conditional normals.

Ranks are taken over the different values of each feature in ranges side by side; a range's offset comes
from a table of a row for each range. Matrices have a row and a column for each feature, and one matrix is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normality import normal_quantile
from .populations import RANGES
from .staging import Staging

#: Rows that a fit needs.
LEAST = 8
# fixed values: how far probabilities stay from 0 and 1, weight of the identity, least eigenvalue
CLIP, SHRINK, FLOOR = 1e-4, 0.1, 1e-6


@F.pandas_udf(T.DoubleType())
def _quantile_of(p: pd.Series) -> pd.Series:
    return pd.Series(normal_quantile(p.to_numpy()))


def _complete(df: DataFrame, features: list[str], group: list[str]) -> DataFrame:
    """Rows whose group is known and whose features are all finite."""
    fine = F.lit(True)
    for g in group:
        fine = fine & F.col(g).isNotNull()
    for c in features:
        x = F.col(c).cast("double")
        fine = fine & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(fine)


def _long(df: DataFrame, features: list[str], *carried: str) -> DataFrame:
    """(carried, feature, value): a row for each value; a negative zero is zero."""
    values = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features])
    return df.select(*carried, F.posexplode(values).alias("feature", "value"))


def _cumulative(long: DataFrame, group: list[str]) -> DataFrame:
    """(group, feature, value, count, below, n): each different value, rows with it, rows with less, and all rows."""
    by = [*group, "feature"]
    at = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    edges = long.groupBy(*by).agg(F.percentile_approx("value", at, F.lit(20 * RANGES)).alias("_e"))
    counts = long.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("count")).join(edges, by)
    counts = counts.withColumn("_r", F.size(F.filter("_e", lambda e: e < F.col("value")))).drop("_e")
    over = Window.partitionBy(*by)  # a row for each range
    upto = over.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*by, "_r").agg(F.sum("count").alias("_s"))
    carried = sums.select(*by, "_r", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_o"), F.sum("_s").over(over).alias("n"))
    own = Window.partitionBy(*by, "_r").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    told = counts.join(carried, [*by, "_r"])
    return told.select(*by, "value", "count", (F.col("_o") + F.coalesce(F.sum("count").over(own), F.lit(0))).alias("below"), "n")


def normal_scores(df: DataFrame, features: list[str], group: list[str], clip: float = CLIP) -> DataFrame:
    """``df`` with ``score_<feature>``: the normal quantile of each value's average rank within the group.

    Rows with a null group or a feature that is null or not finite are left out. The scored rows are a
    written table, in ``spark.checkpoint.dir``.
    """
    st = Staging(df.sparkSession, "copula")
    with st:
        rows = st.table(_complete(df, features, group).withColumn("_id", F.monotonically_increasing_id()))
        long = _long(rows, features, *group, "_id")
        ranks = _cumulative(long.select(*group, "feature", "value"), group)
        p = (F.col("below") + F.col("count") / 2.0) / F.col("n")  # average rank less a half, over n
        scored = ranks.select(*group, "feature", "value", _quantile_of(F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))).alias("_z"))
        wide = long.join(scored, [*group, "feature", "value"]).groupBy("_id").agg(*[F.max(F.when(F.col("feature") == i, F.col("_z"))).alias(f"score_{c}") for i, c in enumerate(features)])
        return st.keep(rows.join(wide, "_id").drop("_id"))


def settled(raw: np.ndarray, shrink: float = SHRINK, floor: float = FLOOR) -> np.ndarray:
    """A correlation matrix drawn towards the identity, with eigenvalues of ``floor`` at least and ones on its diagonal."""
    c = (1 - shrink) * raw + shrink * np.eye(len(raw))
    w, v = np.linalg.eigh(c)
    c = (v * np.maximum(w, floor)) @ v.T
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d)


def fit(scores: DataFrame, features: list[str], group: list[str], shrink: float = SHRINK) -> DataFrame:
    """``(group, n, raw, correlation)`` from scored rows; the matrices row by row as arrays, in the order of ``features``.

    A feature that does not vary correlates with nothing. Groups of fewer than ``LEAST`` rows give none.
    """
    k = len(features)
    z = [F.col(f"score_{c}") for c in features]
    spread = [F.stddev_pop(c) for c in z]
    pairs = [(i, j) for i in range(k) for j in range(i)]
    told = F.array(*[F.when((spread[i] > 1e-12) & (spread[j] > 1e-12), F.try_divide(F.covar_pop(z[i], z[j]), spread[i] * spread[j])).otherwise(0.0) for i, j in pairs]) if pairs else F.array().cast("array<double>")
    sums = scores.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), told.alias("_p")).where(F.col("n") >= LEAST)
    kinds = dict(sums.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, done = [], []
            for p in b.column("_p").to_pylist():
                m = np.eye(k)
                for (i, j), v in zip(pairs, p):
                    m[i, j] = m[j, i] = v
                raw.append(m.reshape(-1).tolist())
                done.append(settled(m, shrink).reshape(-1).tolist())
            kept = [b.column(c) for c in [*group, "n"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(raw, pa.list_(pa.float64())), pa.array(done, pa.list_(pa.float64()))], names=[*group, "n", "raw", "correlation"])

    return sums.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in group), "n long, raw array<double>, correlation array<double>"]))


def pairs(fitted: DataFrame, features: list[str], group: list[str]) -> DataFrame:
    """``(group, n, a, b, raw, correlation)``: a row for each two features of each fit."""
    k = len(features)
    told = F.array(*[F.struct(F.lit(features[j]).alias("a"), F.lit(features[i]).alias("b"), F.col("raw")[i * k + j].alias("raw"), F.col("correlation")[i * k + j].alias("correlation")) for i in range(k) for j in range(i)])
    return fitted.select(*group, "n", F.explode(told).alias("_p")).select(*group, "n", "_p.*")


def conditionals(fitted: DataFrame, features: list[str], target: str, group: list[str]) -> DataFrame:
    """``(group, weights, sd)``: the normal score of ``target`` given those of the other features, from the Cholesky factor with the target last."""
    k = len(features)
    order = [i for i, c in enumerate(features) if c != target] + [features.index(target)]
    kinds = dict(fitted.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights, sd = [], []
            for c in b.column("correlation").to_pylist():
                low = np.linalg.cholesky(np.array(c).reshape(k, k)[np.ix_(order, order)])
                weights.append(np.linalg.solve(low[:-1, :-1].T, low[-1, :-1]).tolist())
                sd.append(float(low[-1, -1]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in group), pa.array(weights, pa.list_(pa.float64())), pa.array(sd)], names=[*group, "weights", "sd"])

    return fitted.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in group), "weights array<double>, sd double"]))


def conditional_scores(scores: DataFrame, fitted: DataFrame, features: list[str], target: str, group: list[str]) -> DataFrame:
    """Scored rows with ``expected`` and ``sd`` of the target's score given the others, and ``residual`` in units of sd. Rows of groups without a fit are left out."""
    one = conditionals(fitted, features, target, group)
    given = [c for c in features if c != target]
    met = scores.join(one, group) if group else scores.crossJoin(F.broadcast(one))  # one row
    expected = sum((F.col("weights")[i] * F.col(f"score_{c}") for i, c in enumerate(given)), F.lit(0.0))
    told = met.withColumn("expected", expected)
    return told.withColumn("residual", (F.col(f"score_{target}") - F.col("expected")) / F.col("sd")).drop("weights")


def feature_quantiles(df: DataFrame, features: list[str], group: list[str], probabilities: list[float]) -> DataFrame:
    """``(group, feature, p, quantile)``: exact, between neighbours in proportion, from cumulative counts; no group is sorted in one task."""
    rows = _cumulative(_long(_complete(df, features, group), features, *group), group)

    def shares(p: Column) -> Column:
        at = p * (F.col("n") - 1)
        low = F.floor(at)
        holds = lambda i: ((i >= F.col("below")) & (i < F.col("below") + F.col("count"))).cast("double")
        return F.struct(p.alias("p"), ((1 - (at - low)) * holds(low) + (at - low) * holds(F.least(low + 1, F.col("n") - 1))).alias("w"))

    met = rows.select(*group, "feature", "value", F.explode(F.filter(F.transform(F.array(*map(F.lit, probabilities)), shares), lambda s: s["w"] > 0)).alias("_s"))
    names = F.array(*map(F.lit, features))
    return met.groupBy(*group, "feature", F.col("_s.p").alias("p")).agg(F.sum(F.col("value") * F.col("_s.w")).alias("quantile")).withColumn("feature", names[F.col("feature")])
