"""Bootstrap on several levels, all replicates in one pass over the rows.

A replicate is a set of weights. A unit of a level (a source, an event of it) draws its weight from a
digest of seed, level, its name and the replicate, a Poisson number of mean one; a row's weight is the product
over its levels. Nothing is drawn in advance or shipped, so that weights agree wherever a
row is met, and on a second run. Replicate 0 has all weights one: it is the sample itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .populations import value_range
from .staging import Staging

#: Probabilities of at most 0, 1, 2, ... of a Poisson number of mean one.
AT_MOST = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
#: Rows whose weights a task holds at a time.
STEP = 2048


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit words spread over the whole word (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(keys: list[np.ndarray], replicates: int, seed: int) -> np.ndarray:
    """(rows, 1 + replicates) weights from the hashed names of each level's unit."""
    out = np.ones((len(keys[0]), replicates + 1))
    step = np.uint64(0x9E3779B97F4A7C15)
    for level, key in enumerate(keys):
        draw = _mixed(np.arange(1, replicates + 1, dtype=np.uint64) * step + np.uint64(seed * 64 + level))
        u = _mixed(key.view(np.uint64)[:, None] ^ draw[None, :]) >> np.uint64(11)
        out[:, 1:] *= np.searchsorted(AT_MOST, u / float(1 << 53), side="right")
    return out


def _keys(levels: list[list[str]]) -> list[Column]:
    """A unit's hashed name, within the levels above."""
    return [F.xxhash64(*[c for level in levels[: i + 1] for c in level]).alias(f"_k{i}") for i in range(len(levels))]


def _added(rows: DataFrame, by: list[str], r: int, names: list[str], measure) -> DataFrame:
    """``(by, replicate, names...)``: arrays (rows, r) that ``measure`` makes of a batch for each name, added up by group in tasks and then over tasks."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                _, first, code = np.unique(b.column("_g").to_numpy(), return_index=True, return_inverse=True)
                total = np.zeros((len(names), len(first), r))
                for t, x in zip(total, measure(b)):
                    np.add.at(t, code, x)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(first)) for c in by), _lists(total.transpose(1, 0, 2).reshape(len(first), -1))], names=[*by, "s"])

    told = rows.withColumn("_g", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    parts = told.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "s array<double>"]))
    summed = parts.select(*by, F.posexplode("s").alias("at", "x")).groupBy(*by, "at").agg(F.sum("x").alias("x"))
    which = F.expr(f"at div {r}")
    return summed.groupBy(*by, (F.col("at") % r).cast("int").alias("replicate")).agg(*[F.max(F.when(which == i, F.col("x"))).alias(n) for i, n in enumerate(names)])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def _weights_of(batch, levels: int, replicates: int, seed: int) -> np.ndarray:
    return weights([batch.column(f"_k{i}").to_numpy() for i in range(levels)], replicates, seed)


def replicate_sums(df: DataFrame, group: list[str], levels: list[list[str]], values: dict[str, Column], replicates: int, seed: int = 0) -> DataFrame:
    """``(group, replicate, weight, values...)``: the weighted sums of each value in each replicate, 0 being the sample itself.

    ``levels`` are the columns that name a unit, from the outermost in. Rows with a null value are
    left out. A task adds its rows up batch by batch; what is shuffled is a row for each group and replicate.
    """
    if not levels or replicates < 0:
        raise ValueError("at least one level, and no fewer than 0 replicates")
    rows = df.select(*group, *_keys(levels), *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(values.values())])
    for i in range(len(values)):
        rows = rows.where(F.col(f"_v{i}").isNotNull())

    n_levels, n_values = len(levels), len(values)

    def measure(b: pa.RecordBatch) -> list[np.ndarray]:
        w = _weights_of(b, n_levels, replicates, seed)
        return [w, *(w * b.column(f"_v{i}").to_numpy()[:, None] for i in range(n_values))]

    return _added(rows, group, replicates + 1, ["weight", *values], measure)


def intervals(replicated: DataFrame, group: list[str], statistic: str, level: float = 0.95) -> DataFrame:
    """``(group, estimate, low, high, replicates)``: replicate 0, and percentiles of the others; undefined ones are left out."""
    tail = (1 - level) / 2
    x, first = F.col(statistic), F.col("replicate") == 0
    known = x.isNotNull() & ~F.isnan(x)
    drawn = F.when(~first & known, x)
    told = replicated.groupBy(*group).agg(F.max(F.when(first, x)).alias("estimate"), F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"), F.count(drawn).alias("replicates"))
    return told.select(*group, "estimate", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "replicates")


def bootstrap_means(df: DataFrame, group: list[str], levels: list[list[str]], value: str, replicates: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """``(group, estimate, low, high, replicates)`` of the mean of ``value``, units of every level drawn with replacement."""
    sums = replicate_sums(df.where(F.col(value).isNotNull()), group, levels, {"total": F.col(value)}, replicates, seed)
    return intervals(sums.withColumn("mean", F.try_divide("total", "weight")), group, "mean", level)


def _ranks(rows: pa.Table, before: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Average ranks in every replicate of rows sorted by value; ``before`` is the weight of smaller values elsewhere."""
    v = rows.column("v").to_numpy()
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    tied = np.add.reduceat(w, starts, axis=0)
    under = before[None, :] + np.cumsum(tied, 0) - tied
    return np.repeat(under + (tied + 1) / 2, np.diff(np.r_[starts, len(v)]), axis=0)


def replicate_rank_sums(st: Staging, df: DataFrame, group: list[str], levels: list[list[str]], columns: list[str], replicates: int, seed: int = 0, range_rows: int = 4096) -> DataFrame:
    """``(group, replicate, n, s0.., s0_0, s0_1..)``: weights, weighted sums of average ranks and of their products.

    Ranks are those within the replicate: a unit drawn twice counts twice. A column is ranked in ranges of
    its value side by side, about ``range_rows`` rows each (2,048 ranges at most); a table of the ranges' weights carries
    ranks over. Rows with a null, infinite or not-a-number value in any column are left out. Ranks in all replicates
    go through a shuffle, which is 8 bytes for each row, column and replicate.
    """
    x = [F.col(c).cast("double") for c in columns]
    fine = F.lit(True)
    for c in x:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    n_levels, m, r = len(levels), len(columns), replicates + 1
    keys = [f"_k{i}" for i in range(n_levels)]
    grp = F.struct(*[F.col(c) for c in group]) if group else F.struct(F.lit(0).alias("_"))
    rows = st.table(df.where(fine).select(grp.alias("_grp"), *_keys(levels), *[(c + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(x)], F.monotonically_increasing_id().alias("_id")))
    ranges = max(1, min(2048, rows.count() // range_rows))
    long = []
    for i in range(m):
        at = value_range(rows, f"x{i}", ranges) if ranges > 1 else F.lit(0)
        long.append(rows.select("_grp", "_id", *keys, F.lit(i).alias("_var"), F.col(f"x{i}").alias("v"), at.cast("int").alias("_range")))
    every = long[0]
    for one in long[1:]:
        every = every.union(one)
    every = st.table(every)
    by = ["_grp", "_var", "_range"]
    held = _added(every, by, r, ["x"], lambda b: [_weights_of(b, n_levels, replicates, seed)])
    before = F.coalesce(F.sum("x").over(Window.partitionBy("_grp", "_var", "replicate").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    carried = held.withColumn("b", before).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("replicate", "b"))).alias("l")).select(*by, F.transform("l", lambda e: e["b"]).alias("before"))

    def rank(part: pa.Table, before: pa.Table) -> pa.Table:
        part = part.sort_by([("v", "ascending")])
        w = _weights_of(part, n_levels, replicates, seed)
        ranks = _ranks(part, np.asarray(before.column("before")[0].as_py()), w)
        return pa.table({"_id": part.column("_id"), "_var": part.column("_var"), "r": _lists(ranks)})

    ranked = st.table(every.groupBy(*by).cogroup(carried.groupBy(*by)).applyInArrow(rank, "_id long, _var int, r array<double>"))
    wide = rows.select("_grp", "_id", *keys)
    for i in range(m):
        wide = wide.join(ranked.where(F.col("_var") == i).select("_id", F.col("r").alias(f"r{i}")), "_id")
    pairs = [(i, j) for i in range(m) for j in range(i, m)]

    def products(b: pa.RecordBatch) -> list[np.ndarray]:
        w = _weights_of(b, n_levels, replicates, seed)
        a = [b.column(f"r{i}").flatten().to_numpy().reshape(-1, r) for i in range(m)]
        return [w, *(w * y for y in a), *(w * a[i] * a[j] for i, j in pairs)]

    told = ["n", *(f"s{i}" for i in range(m)), *(f"s{i}_{j}" for i, j in pairs)]
    out = _added(wide.drop("_id"), ["_grp"], r, told, products)
    return out.select(*[F.col(f"_grp.{c}").alias(c) for c in group], "replicate", *told)


def correlations(n: float, s: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Correlations and partial correlations (the others held fixed) from sums; None where a column is constant or there are under three rows."""
    if n < 3:
        return None
    cov = products / n - np.outer(s, s) / n / n
    d = np.diag(cov)
    if (d <= 1e-12 * np.maximum(1.0, (s / n) ** 2)).any():
        return None
    c = cov / np.sqrt(np.outer(d, d))
    inverse = np.linalg.pinv(c, hermitian=True)
    e = np.diag(inverse)
    partial = -inverse / np.sqrt(np.outer(e, e))
    np.fill_diagonal(partial, 1.0)
    return c, partial


def bootstrap_spearman(df: DataFrame, group: list[str], levels: list[list[str]], columns: list[str], replicates: int = 200, seed: int = 0, level: float = 0.95, range_rows: int = 4096) -> DataFrame:
    """``(group, x, y, n, rho, low, high, partial, partial_low, partial_high, replicates)`` for each two of ``columns``.

    Rank correlation of the sample, partial ones with all other columns held fixed, and percentile intervals over replicates in
    which units of all levels are drawn with replacement and ranks are taken anew. Replicates in which a column is constant
    are left out and not counted; a group with a constant column, or with under three rows, has nulls.
    """
    m = len(columns)
    with Staging(df.sparkSession, "spearman") as st:
        sums = st.keep(replicate_rank_sums(st, df, group, levels, columns, replicates, seed, range_rows))
    head = ", ".join(f"`{c}` {t}" for c, t in sums.dtypes if c in group)
    tail = 100 * (1 - level) / 2

    def summary(t: pa.Table) -> pa.Table:
        t = t.sort_by([("replicate", "ascending")])
        made = []
        for row in t.to_pylist():  # a row for each replicate
            p = np.zeros((m, m))
            for i in range(m):
                for j in range(i, m):
                    p[i, j] = p[j, i] = row[f"s{i}_{j}"]
            made.append(correlations(row["n"], np.array([row[f"s{i}"] for i in range(m)]), p))
        first, rest = made[0], [x for x in made[1:] if x is not None]
        out = []
        for i in range(m):
            for j in range(i + 1, m):
                told = {"x": columns[i], "y": columns[j], "n": int(t.column("n")[0].as_py()), "replicates": len(rest)}
                for k, (name, stem) in enumerate((("rho", ""), ("partial", "partial_"))):
                    ends = np.percentile([x[k][i, j] for x in rest], [tail, 100 - tail]) if rest else (None, None)
                    told |= {name: float(first[k][i, j]) if first else None, stem + "low": ends[0], stem + "high": ends[1]}
                out.append(told)
        kinds = {"x": pa.string(), "y": pa.string(), "n": pa.int64(), **{c: pa.float64() for c in ("rho", "low", "high", "partial", "partial_low", "partial_high")}, "replicates": pa.int32()}
        same = t.select(group).take(pa.array([0] * len(out), pa.int64()))
        return pa.table({**{c: same.column(c) for c in group}, **{c: pa.array([d[c] for d in out], k) for c, k in kinds.items()}})

    tells = "x string, y string, n long, rho double, low double, high double, partial double, partial_low double, partial_high double, replicates int"
    one = sums if group else sums.withColumn("_one", F.lit(0))
    return one.groupBy(*(group or ["_one"])).applyInArrow(summary, f"{head}, {tells}" if group else tells)
