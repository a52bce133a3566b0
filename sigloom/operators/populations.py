"""Comparisons of populations: rank tests, distances between distributions, bins, grids, sweeps and memberships.

Ranks over a whole table are taken in ranges of the value. The range edges come from one
approximate-quantile aggregate; ranges are windows of their own, and a table
of their totals, a row for each range, carries the counts over from one to the next. Equal
values are always in one range, so ranks are exact whatever the edges are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .coverage import exact_quantile, exact_quantiles

#: Ranges of a value that are ranked side by side.
RANGES = 64


def value_range(df: DataFrame, value: str, ranges: int = RANGES) -> Column:
    """The number of a row's range of ``value``; ranges hold about equally many rows, equal values one range."""
    at = [i / ranges for i in range(1, ranges)]
    edges = df.agg(F.percentile_approx(value, F.array(*map(F.lit, at)), F.lit(20 * ranges)).alias("e")).first().e or []
    told = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    return F.size(F.filter(told, lambda e: e < F.col(value)))


def _cumulative(df: DataFrame, value: str, group: str, groups: list) -> DataFrame:
    """A row for each distinct value: counts c0.. by group, counts b0.. of smaller values, and the next value."""
    kept = df.where(F.col(value).isNotNull() & F.col(group).isin(groups)).select(F.col(value).cast("double").alias("value"), F.col(group).alias("group"))
    counts = kept.groupBy("value").agg(*[F.sum(F.when(F.col("group") == g, 1).otherwise(0)).alias(f"c{i}") for i, g in enumerate(groups)])
    counts = counts.withColumn("range", value_range(kept, "value"))
    sums = counts.groupBy("range").agg(F.min("value").alias("least"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(len(groups))])
    over = Window.orderBy("range")  # a row for each range, RANGES at most
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("range", F.lead("least").over(over).alias("after"), *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"o{i}") for i in range(len(groups))])
    own = Window.partitionBy("range").orderBy("value")
    told = counts.join(F.broadcast(carried), "range")
    below = [(F.col(f"o{i}") + F.coalesce(F.sum(f"c{i}").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(f"b{i}") for i in range(len(groups))]
    return told.select("value", F.coalesce(F.lead("value").over(own), F.col("after")).alias("next"), *[f"c{i}" for i in range(len(groups))], *below)


def kruskal(df: DataFrame, value: str, group: str, groups: list) -> DataFrame:
    """One row: n, h (corrected for ties) and the degrees of freedom of the rank test over all groups; h is null where all values are equal or there are none."""
    rows = _cumulative(df, value, group, groups)
    k = range(len(groups))
    plus = lambda p: sum((F.col(f"{p}{i}") for i in k), F.lit(0))
    tied = rows.withColumn("t", plus("c").cast("double")).withColumn("rank", plus("b") + (F.col("t") + 1) / 2)
    sums = tied.agg(F.sum("t").alias("n"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), *[F.sum(f"c{i}").alias(f"n{i}") for i in k], *[F.sum(F.col("rank") * F.col(f"c{i}")).alias(f"r{i}") for i in k])
    n = F.col("n")
    square = sum((F.when(F.col(f"n{i}") > 0, F.col(f"r{i}") * F.col(f"r{i}") / F.col(f"n{i}")).otherwise(0.0) for i in k), F.lit(0.0))
    spread = 1 - F.try_divide(F.col("ties"), n * n * n - n)
    h = F.try_divide(12 / (n * (n + 1)) * square - 3 * (n + 1), spread)
    used = sum((F.when(F.col(f"n{i}") > 0, 1).otherwise(0) for i in k), F.lit(0))
    return sums.select(F.coalesce(n, F.lit(0.0)).cast("long").alias("n"), h.alias("h"), F.greatest(used - 1, F.lit(0)).cast("int").alias("df"))


def mann_whitney(df: DataFrame, value: str, group: str, groups: list) -> DataFrame:
    """For each pair of groups: u of the first, z (corrected for ties and continuity; null where a side is empty or all values are equal); all pairs from one pass over distinct values."""
    rows = _cumulative(df, value, group, groups)
    pairs = [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
    cols = []
    for i, j in pairs:
        t = (F.col(f"c{i}") + F.col(f"c{j}")).cast("double")
        cols += [F.sum(F.col(f"c{i}") * (F.col(f"b{j}") + F.col(f"c{j}") / 2)).alias(f"u{i}_{j}"), F.sum(t * t * t - t).alias(f"t{i}_{j}")]
    sums = rows.agg(*cols, *[F.sum(f"c{i}").cast("double").alias(f"n{i}") for i in range(len(groups))])
    told = F.array(*[F.struct(F.lit(groups[i]).alias("a"), F.lit(groups[j]).alias("b"), F.col(f"n{i}").alias("m"), F.col(f"n{j}").alias("n"), F.col(f"u{i}_{j}").alias("u"), F.col(f"t{i}_{j}").alias("t")) for i, j in pairs])
    one = sums.select(F.explode(told).alias("p")).select("p.*")
    mn, total = F.col("m") * F.col("n"), F.col("m") + F.col("n")
    spread = F.sqrt(mn / 12 * ((total + 1) - F.try_divide(F.col("t"), total * (total - 1))))
    far = F.col("u") - mn / 2
    z = F.when(spread > 0, F.signum(far) * F.greatest(F.abs(far) - 0.5, F.lit(0.0)) / spread)
    return one.select("a", "b", F.col("m").cast("long").alias("n_a"), F.col("n").cast("long").alias("n_b"), "u", z.alias("z"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: f and its degrees of freedom, from counts, means and squares of deviations of each group.

    f is null with fewer than two groups, with no more rows than groups, and where no group varies.
    """
    one = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = one.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"))
    between = F.col("squares") - F.col("n") * F.col("mean") * F.col("mean")
    f = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    return total.select(f.alias("f"), F.greatest(F.col("k") - 1, F.lit(0)).alias("df_between"), F.coalesce(F.col("n") - F.col("k"), F.lit(0)).alias("df_within"))


def distances(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """One row: Kolmogorov-Smirnov, first Wasserstein and energy distance of two groups, by their distribution functions over distinct values; nulls where one is empty."""
    rows = _cumulative(df, value, group, [a, b])
    size = rows.agg(F.sum("c0").alias("m"), F.sum("c1").alias("n"))
    told = rows.crossJoin(F.broadcast(size))  # one row
    gap = F.try_divide(F.col("b0") + F.col("c0"), F.col("m")) - F.try_divide(F.col("b1") + F.col("c1"), F.col("n"))
    wide = F.coalesce(F.col("next") - F.col("value"), F.lit(0.0))
    return told.agg(F.max(F.abs(gap)).alias("ks"), F.sum(F.abs(gap) * wide).alias("wasserstein"), (2 * F.sum(gap * gap * wide)).alias("energy"))


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """The different edges of ``bins`` equally full bins, exact, without gathering the values."""
    return sorted(set(exact_quantiles(df, value, [i / bins for i in range(bins + 1)])))


def _bin(value: Column, edges: list[float]) -> Column:
    """0.. by half-open bins, the last one closed; null outside."""
    inner = sum(((value >= F.lit(float(e))).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when(value.between(edges[0], edges[-1]), inner)


def binned_median(df: DataFrame, x: str, y: str, bins: int = 10, least: int = 3) -> DataFrame:
    """``(bin, n, median_x, median_y)`` over quantile bins of x; bins with fewer than ``least`` points are left out."""
    edges = quantile_edges(df, x, bins)
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if len(edges) < 2:
        return kept.limit(0).select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n"), F.col(x).alias("median_x"), F.col(y).alias("median_y"))
    binned = kept.select(_bin(F.col(x), edges).alias("bin"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    median = lambda c: exact_quantile(binned, ["bin"], c, 0.5)
    told = median("_x").select("bin", "n", F.col("quantile").alias("median_x")).join(median("_y").select(F.col("bin").alias("_b"), F.col("quantile").alias("median_y")), F.col("bin").eqNullSafe(F.col("_b")))
    return told.select("bin", "n", "median_x", "median_y").where(F.col("n") >= least)


def support_grid(df: DataFrame, x: str, y: str, supported: Column, x_edges: list[float], y_edges: list[float]) -> DataFrame:
    """``(x_bin, y_bin, n, supported, rate)`` for every cell of the grid; the rate is null where a cell is empty."""
    told = df.select(_bin(F.col(x), x_edges).alias("x_bin"), _bin(F.col(y), y_edges).alias("y_bin"), supported.alias("_s")).where("x_bin is not null and y_bin is not null")
    counts = told.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_s").cast("int")).alias("supported"))
    cells = df.sparkSession.range((len(x_edges) - 1) * (len(y_edges) - 1)).select((F.col("id") / (len(y_edges) - 1)).cast("int").alias("x_bin"), (F.col("id") % (len(y_edges) - 1)).cast("int").alias("y_bin"))
    full = cells.join(counts, ["x_bin", "y_bin"], "left").na.fill({"n": 0, "supported": 0})
    return full.select("x_bin", "y_bin", "n", "supported", F.when(F.col("n") > 0, F.col("supported") / F.col("n")).alias("rate"))


def threshold_sweep(df: DataFrame, score: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """``(threshold, accepted, precision, recall, f1)`` for each of the thresholds, ascending.

    Rows are counted once, by how many thresholds they reach; the sums run over that short table.
    """
    passed = F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col(score)))
    counts = df.where(F.col(score).isNotNull()).groupBy(passed.alias("passed")).agg(F.count(F.lit(1)).alias("n"), F.sum(positive.cast("int")).alias("p"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)], "k int, threshold double")
    total = counts.agg(F.sum("p").alias("all_p"))
    sums = F.broadcast(grid).join(counts, F.col("passed") >= F.col("k"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("accepted"), F.coalesce(F.sum("p"), F.lit(0)).alias("hit"))
    told = sums.crossJoin(F.broadcast(total))  # one row
    precision, recall = F.when(F.col("accepted") > 0, F.col("hit") / F.col("accepted")), F.when(F.col("all_p") > 0, F.col("hit") / F.col("all_p"))
    return told.select("threshold", "accepted", precision.alias("precision"), recall.alias("recall"), F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("accepted") + F.col("all_p"))).otherwise(0.0).alias("f1"))


def membership_rates(df: DataFrame, group: list[str], members: dict[str, Column]) -> DataFrame:
    """``(group, kind, rate)``: the share of rows in each set, in each two, in any, in none and in all."""
    names = list(members)
    flags = df.select(*group, *[m.alias(f"_{i}") for i, m in enumerate(members.values())])
    flag = lambda i: F.col(f"_{i}")
    kinds = {n: flag(i) for i, n in enumerate(names)}
    kinds |= {f"{a}&{b}": flag(i) & flag(j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    some, every = flag(0), flag(0)
    for i in range(1, len(names)):
        some, every = some | flag(i), every & flag(i)
    kinds |= {"any": some, "none": ~some, "all": every}
    rates = flags.groupBy(*group).agg(*[F.avg(c.cast("double")).alias(f"r{i}") for i, c in enumerate(kinds.values())])
    return rates.select(*group, F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(f"r{i}").alias("rate")) for i, n in enumerate(kinds)])).alias("x")).select(*group, "x.kind", "x.rate")


def tier_summary(df: DataFrame, tier: str, accepted: Column, value: str, reason: str) -> DataFrame:
    """By tier: rows, accepted rows, the median of ``value`` of accepted and of other rows, and the reasons as a text of counts."""
    by = df.groupBy(tier).agg(F.count(F.lit(1)).alias("n"), F.count_if(accepted).alias("accepted"), F.percentile(F.when(accepted, F.col(value)), F.lit(0.5)).alias("median_accepted"), F.percentile(F.when(~accepted, F.col(value)), F.lit(0.5)).alias("median_other"))
    counted = df.groupBy(tier, reason).agg(F.count(F.lit(1)).alias("k"))
    told = counted.groupBy(tier).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(reason).alias("r"), "k"))), lambda x: F.concat_ws(":", x["r"], x["k"].cast("string"))), ",").alias("reasons"))
    return by.join(told, tier)


def distribution_overlap(df: DataFrame, group: str, band: Column) -> DataFrame:
    """``(a, b, overlap)`` for each two groups: the sum over bands of the lesser share."""
    counts = df.groupBy(group, band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
    one = share.select(F.col(group).alias("a"), "band", F.col("share").alias("x"))
    two = share.select(F.col(group).alias("b"), "band", F.col("share").alias("y"))
    return one.join(two, "band").where("a < b").groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("overlap"))


def slowdown(df: DataFrame, group: list[str], x: str, y: str, share: float = 0.2, smooth_from: int = 5, plateau: float = 0.95) -> DataFrame:
    """``(group, threshold)``: where a curve stops rising, by its slope from each x to the next.

    The first x beyond the steepest step whose own step has ``share`` of the steepest slope or less; if there is
    none, the first x whose y reaches ``plateau`` of the greatest; on a curve that never rises the first x; null with fewer than three points. Curves
    of ``smooth_from`` points or more are smoothed over three points first, end points counting twice at the ends.
    """
    w, all_ = Window.partitionBy(*group).orderBy(x), Window.partitionBy(*group)
    told = df.withColumn("_n", F.count(F.lit(1)).over(all_))
    smooth = (F.coalesce(F.lag(y).over(w), F.col(y)) + F.col(y) + F.coalesce(F.lead(y).over(w), F.col(y))) / 3
    told = told.withColumn("_s", F.when(F.col("_n") >= smooth_from, smooth).otherwise(F.col(y)))
    told = told.withColumn("_d", (F.col("_s") - F.lag("_s").over(w)) / F.greatest(F.col(x) - F.lag(x).over(w), F.lit(1e-9)))
    told = told.withColumn("_peak", F.max("_d").over(all_)).withColumn("_top", F.max("_s").over(all_))
    told = told.withColumn("_at", F.min(F.when(F.col("_d") == F.col("_peak"), F.col(x))).over(all_))
    after = F.min(F.when((F.col(x) > F.col("_at")) & (F.col("_d") <= share * F.col("_peak")), F.col(x)))
    reached = F.coalesce(F.min(F.when(F.col("_s") >= plateau * F.col("_top"), F.col(x))), F.max(x))
    rising = F.max("_peak") > 0
    return told.groupBy(*group).agg(F.when(F.max("_n") < 3, None).when(rising, F.coalesce(after, reached)).otherwise(F.min(x)).alias("threshold"))


def scaled_distance(center: dict[str, float], scales: dict[str, float], weights: dict[str, float] | None = None) -> Column:
    """The weighted distance of a row from a centre, each value in units of its scale; null if one is missing."""
    weights = weights or dict.fromkeys(center, 1.0)
    total = sum(weights.values())
    terms = [F.lit(weights[c] / total) * F.pow((F.col(c) - v) / scales[c], 2) for c, v in center.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.sqrt(out)


def normal_tail(z: float) -> float:
    """The two-sided probability of a standard normal value at least as far out."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """The probability of a chi-squared value above x, by the series or the continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= h / n
            total += term
        return 1 - total * scale
    b = h + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 500):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * scale
