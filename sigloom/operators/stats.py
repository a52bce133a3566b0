"""Rank correlation, agreement, classification scores, thresholds and resampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation, null where either side is constant."""
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.corr(x, y))


def average_rank(x: str, group: list[str]) -> Column:
    """Rank from 1 with ties averaged."""
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, x)) - 1) / 2.0


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks over rows where both are known."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = rows.withColumn("_x", average_rank(x, group)).withColumn("_y", average_rank(y, group))
    return ranks.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), guarded_corr("_x", "_y").alias("rho"))


def partial_correlation(df: DataFrame, group: list[str], x: str, y: str, given: str) -> DataFrame:
    """Correlation of x and y with ``given`` held fixed, from the three pairwise ones."""
    r = df.where(" and ".join(f"{c} is not null" for c in (x, y, given))).groupBy(*group).agg(guarded_corr(x, y).alias("xy"), guarded_corr(x, given).alias("xz"), guarded_corr(y, given).alias("yz"))
    bottom = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return r.select(*group, F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), bottom).alias("partial"))


def kappa(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Agreement and Cohen's kappa of two boolean raters; kappa is null when chance agreement is total."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), F.avg(F.col(a).cast("double")).alias("_a"), F.avg(F.col(b).cast("double")).alias("_b"))
    chance = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    return t.select(*group, "n", "agreement", F.when(chance < 1, (F.col("agreement") - chance) / (1 - chance)).alias("kappa"))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each label that is true or predicted anywhere."""
    long = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    s = long.where("label is not null").groupBy("label").agg(F.sum("hit").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_predicted"))
    return s.withColumn("precision", F.try_divide("tp", "n_predicted")).withColumn("recall", F.try_divide("tp", "n_true")).withColumn("f1", 2.0 * F.col("tp") / (F.col("n_true") + F.col("n_predicted")))


def count_proxy(df: DataFrame, group: list[str], predicted: str, true: str) -> DataFrame:
    """True and false positives and negatives by counts alone: shared, surplus and missing."""
    z = F.lit(0)
    s = df.groupBy(*group).agg(F.sum(F.least(predicted, true)).alias("tp"), F.sum(F.greatest(F.col(predicted) - F.col(true), z)).alias("fp"), F.sum(F.greatest(F.col(true) - F.col(predicted), z)).alias("fn"), F.avg(F.abs(F.col(predicted) - F.col(true))).alias("mae"))
    return s.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def binned_accuracy(df: DataFrame, group: list[str], bin_: Column, correct: Column) -> DataFrame:
    return df.withColumn("bin", bin_).where("bin is not null").groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("accuracy"))


def first_crossing(df: DataFrame, group: list[str], x: str, y: str, target: float) -> DataFrame:
    """Where y, interpolated along x, first reaches the target; null where it never does."""
    w = Window.partitionBy(*group).orderBy(x)
    px, py = F.lag(x).over(w), F.lag(y).over(w)
    at = F.when(py.isNull() | (F.col(y) == py), F.col(x)).otherwise(px + (target - py) * (F.col(x) - px) / (F.col(y) - py))
    hit = df.withColumn("_at", F.when((F.col(y) >= target) & (py.isNull() | (py < target)), at))
    return hit.groupBy(*group).agg(F.min_by("_at", F.when(F.col("_at").isNotNull(), F.col(x))).alias("threshold"))


def sustained_crossing(df: DataFrame, group: list[str], x: str, y: str, target: float) -> DataFrame:
    """The least x from which y stays at or above the target; null where the last y is below it."""
    w = Window.partitionBy(*group).orderBy(x).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("_ok", F.min(y).over(w) >= target).groupBy(*group).agg(F.min(F.when(F.col("_ok"), F.col(x))).alias("threshold"))


def stratum_weights(population: DataFrame, reviewed: DataFrame, strata: list[str]) -> DataFrame:
    """Rows of the population that each reviewed row of a stratum stands for."""
    p, r = (d.groupBy(*strata).agg(F.count(F.lit(1)).alias(n)) for d, n in ((population, "population"), (reviewed, "reviewed")))
    return p.join(r, strata).withColumn("weight", F.col("population") / F.col("reviewed"))


def cluster_bootstrap(df: DataFrame, group: list[str], cluster: str, value: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval when whole clusters are drawn with replacement.

    Clusters are summed first; each then gets Poisson weights, drawn from a generator
    seeded by its name, so that the resampling needs no exchange of rows.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*group, cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    keys = ", ".join(f"`{c}` {t}" for c, t in sums.dtypes if c in group)

    def draw(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            names, s, n = t.column(cluster).to_pylist(), t.column("s").to_numpy(), t.column("n").to_numpy()
            import zlib

            w = np.stack([np.random.default_rng([seed, zlib.crc32(str(c).encode())]).poisson(1.0, replicates) for c in names]) if names else np.empty((0, replicates))
            rows = t.select(group)
            yield from rows.append_column("ws", pa.array((w * s[:, None]).tolist(), pa.list_(pa.float64()))).append_column("wn", pa.array((w * n[:, None]).astype(float).tolist(), pa.list_(pa.float64()))).append_column("s", t.column("s").cast(pa.float64())).append_column("n", t.column("n")).to_batches()

    drawn = sums.mapInArrow(draw, f"{keys}{', ' if keys else ''}ws array<double>, wn array<double>, s double, n long")
    long = drawn.select(*group, F.posexplode(F.arrays_zip("ws", "wn")).alias("replicate", "x")).groupBy(*group, "replicate").agg(F.try_divide(F.sum("x.ws"), F.sum("x.wn")).alias("m"))
    tail = (1 - level) / 2
    q = long.groupBy(*group).agg(F.percentile("m", [tail, 1 - tail]).alias("_q"))
    mean = drawn.groupBy(*group).agg((F.sum("s") / F.sum("n")).alias("mean"))
    out = mean.join(q, group) if group else mean.crossJoin(q)
    return out.select(*group, "mean", F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"))


def grouped_array(df: DataFrame, group: list[str], columns: list[str], schema: str, f: Callable[[dict[str, np.ndarray]], dict[str, float]]) -> DataFrame:
    """One row for each group from its columns as arrays, for estimators that need them whole (one group, one task)."""
    out = ", ".join([*(f"`{c}` {dict(df.dtypes)[c]}" for c in group), schema])

    def run(table: pa.Table) -> pa.Table:
        made = f({c: table.column(c).to_numpy() for c in columns})
        return pa.table({**{c: table.column(c).slice(0, 1) for c in group}, **{k: [v] for k, v in made.items()}})

    return df.select(*group, *columns).groupBy(*group).applyInArrow(run, out)


def kde_mode(values: np.ndarray, points: int = 512) -> float:
    """Mode of a Gaussian kernel density with Silverman's bandwidth, on a grid over the range."""
    x = np.sort(values[np.isfinite(values)])
    if not len(x):
        return float("nan")
    s = min(x.std(ddof=1) if len(x) > 1 else 0.0, (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34 or np.inf)
    if not s or not np.isfinite(s):
        return float(np.median(x))
    h = 0.9 * s * len(x) ** -0.2
    grid = np.linspace(x[0], x[-1], points)
    dens = np.zeros(points)
    for i in range(0, len(x), 4096):
        dens += np.exp(-0.5 * ((grid[:, None] - x[None, i : i + 4096]) / h) ** 2).sum(1)
    return float(grid[dens.argmax()])


def positive_definite(correlation: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Shrink a correlation matrix towards the identity until its least eigenvalue reaches ``floor``."""
    least = float(np.linalg.eigvalsh(correlation)[0])
    if least >= floor:
        return correlation
    t = (floor - least) / (1 - least)
    return (1 - t) * correlation + t * np.eye(len(correlation))
