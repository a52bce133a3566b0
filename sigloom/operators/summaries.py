"""Grouped summaries with the conventions that matter: population or sample deviation, dense groups, exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_std(x: Column | str) -> Column:
    """Sample deviation, 0 for a single value, null for none."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def class_summary(df: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Count, mean and population deviation of each value column; nulls are skipped."""
    aggs = [a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"))]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *aggs)


def percentile_summary(df: DataFrame, group: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """n, mean, sample deviation, linear-interpolated quantiles and maximum."""
    q = F.percentile(value, list(quantiles.values()))
    out = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sample_std(value).alias("std"), q.alias("_q"), F.max(value).alias("max"))
    return out.select(*group, "n", "mean", "std", *[F.get("_q", F.lit(i)).alias(k) for i, k in enumerate(quantiles)], "max")


def iqr_scale(value: str, floor: float) -> tuple[Column, Column]:
    """Median and interquartile range, the latter at least ``floor``."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    return F.get(q, F.lit(1)), F.greatest(F.get(q, F.lit(2)) - F.get(q, F.lit(0)), F.lit(floor))


def dense(df: DataFrame, agg: DataFrame, group: list[str], declared: dict[str, list], counts: list[str]) -> DataFrame:
    """``agg`` with a row for every declared combination; counts of absent ones are 0."""
    spark = df.sparkSession
    frame = None
    for c, values in declared.items():
        one = spark.createDataFrame([(v,) for v in values], f"`{c}` {dict(df.dtypes).get(c, 'double')}")
        frame = one if frame is None else frame.crossJoin(one)  # declared values: a fixed list
    out = frame.join(agg, group, "left")
    return out.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.col(c) for c in agg.columns])


def threshold_counts(df: DataFrame, group: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """Rows at or above each threshold, in one pass over the rows."""
    hits = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(value) >= t).alias("n")) for t in thresholds]
    return df.groupBy(*group).agg(F.array(*hits).alias("_h")).select(*group, F.explode("_h").alias("h")).select(*group, "h.threshold", "h.n")


def histogram(df: DataFrame, group: list[str], band: Column, name: str = "band") -> DataFrame:
    """Counts by band with their percentage of the group."""
    n = df.withColumn(name, band).where(F.col(name).isNotNull()).groupBy(*group, name).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def reduction_pivot(df: DataFrame, group: str, kind: str, raw: str, filtered: str, value: Column) -> DataFrame:
    """A value aggregated for two kinds side by side, with what the second takes off the first."""
    p = df.groupBy(group).pivot(kind, [raw, filtered]).agg(value)
    return p.select(group, F.col(raw).alias("raw"), F.col(filtered).alias("filtered"), F.when(F.col(raw) > 0, 1 - F.col(filtered) / F.col(raw)).alias("reduction"))


def against_baseline(df: DataFrame, group: str, variant: str, value: str, baseline: str) -> DataFrame:
    """Each variant beside the baseline of its group."""
    base = df.where(F.col(variant) == baseline).select(group, F.col(value).alias("baseline"))
    out = df.join(base, group)
    return out.withColumn("delta", F.col(value) - F.col("baseline")).withColumn("reduction_percent", F.when(F.col("baseline") > 0, 100 * (1 - F.col(value) / F.col("baseline"))))


def grouping_sets(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """Aggregates over several groupings in one pass; columns that a set leaves out are null, ``level`` numbers the sets."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rows = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return rows.agg(F.grouping_id().alias("level"), *aggs)


def worst(df: DataFrame, group: str, value: str, high: float, k: int) -> DataFrame:
    """The k groups with most rows above ``high``, then the largest maximum, then the least name."""
    return df.groupBy(group).agg(F.max(value).alias("max"), F.count_if(F.col(value) > high).alias("n_high")).orderBy(F.desc("n_high"), F.desc("max"), group).limit(k)


def duplicate_groups(df: DataFrame, content: list[str], key: str) -> DataFrame:
    """Contents that two or more rows share: n, the canonical (least) key, and every key in order."""
    return df.groupBy(*content).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("canonical"), F.array_sort(F.collect_set(key)).alias("members")).where("n >= 2")


def robust_z(df: DataFrame, group: list[str], value: str, scale: float = 1.0, floor: float = 1e-12) -> DataFrame:
    """``z``: distance from the group's median in (scaled) median absolute deviations, at least ``floor``."""
    med = df.groupBy(*group).agg(F.median(value).alias("_med"))
    with_med = df.join(med, group)
    mad = with_med.groupBy(*group).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    return with_med.join(mad, group).withColumn("z", (F.col(value) - F.col("_med")) / F.greatest(scale * F.col("_mad"), F.lit(floor))).drop("_med", "_mad")


def percentile_rank(df: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """(rank - 1/2) / n in percent, ties by key."""
    w = Window.partitionBy(*group)
    return df.withColumn("percentile_rank", 100.0 * (F.row_number().over(w.orderBy(value, key)) - 0.5) / F.count(F.lit(1)).over(w))


def effective_size(weight: str) -> Column:
    """(sum w)^2 / sum w^2."""
    return F.try_divide(F.sum(weight) * F.sum(weight), F.sum(F.col(weight) * F.col(weight)))


def reasons(df: DataFrame, rules: list[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """``reason``: the first rule that holds, else ``kept``; both sides of a filter in one column."""
    out = F.lit(kept)
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return df.withColumn("reason", out)


def leaks(df: DataFrame, owner: str, keys: list[str]) -> DataFrame:
    """Key values that more than one owner has; an isolation audit passes when there are none."""
    long = df.select(owner, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")).select(owner, "x.key", "x.value")
    return long.where("value is not null").groupBy("key", "value").agg(F.count_distinct(owner).alias("owners"), F.count(F.lit(1)).alias("n")).where("owners > 1")


def changes(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Full comparison by key: removed, new, changed or retained."""
    a, b = old.select(*key, F.struct(*columns).alias("_a")), new.select(*key, F.struct(*columns).alias("_b"))
    status = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "new").when(F.col("_a").eqNullSafe(F.col("_b")), "retained").otherwise("changed")
    return a.join(b, key, "full_outer").withColumn("status", status)
