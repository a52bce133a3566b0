"""Interval algebra with window functions: runs, merges, complements, sweeps and boundaries.

Rows are intervals ``start``, ``end`` (half-open) under key columns; every window
is partitioned by the keys, so one key's intervals are one task's work, sorted and
spilled by Spark where they are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: str, active: Column, max_gap: int = 0) -> DataFrame:
    """Maximal runs of active rows: keys, first and last order value, n.

    Rows are numbered within the keys; a stretch of more than ``max_gap`` inactive rows splits.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    on = df.withColumn("_i", F.row_number().over(w)).where(active)
    split = F.coalesce(F.col("_i") - F.lag("_i").over(w) > max_gap + 1, F.lit(True))
    grouped = on.withColumn("_g", F.sum(split.cast("int")).over(w))
    return grouped.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def merge(df: DataFrame, keys: list[str], gap: float = 0, n: Column | None = None) -> DataFrame:
    """Union of intervals; those that touch, or are up to ``gap`` apart, become one. ``n`` clips to [0, n)."""
    if n is not None:
        df = df.withColumn("start", F.greatest(F.lit(0), F.col("start"))).withColumn("end", F.least(n, F.col("end")))
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > before + gap, F.lit(True)).cast("int")
    marked = df.where("start < end").select(*keys, "start", "end", new.alias("_new"))
    grouped = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_g")


def expand(df: DataFrame, keys: list[str], before: float, after: float, n: Column) -> DataFrame:
    """Guard each interval on both sides, then merge."""
    return merge(df.withColumn("start", F.col("start") - before).withColumn("end", F.col("end") + after), keys, n=n)


def complement(df: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """What merged intervals leave of [low, high) in each key that has any."""
    w = Window.partitionBy(*keys).orderBy("start")
    m = merge(df, keys).withColumn("_low", low).withColumn("_high", high)
    gaps = m.select(*keys, "_low", "_high", F.col("end").alias("start"), F.coalesce(F.lead("start").over(w), F.col("_high")).alias("end"))
    first = m.groupBy(*keys).agg(F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.min("start").alias("end")).withColumn("start", F.col("_low"))
    both = gaps.unionByName(first).withColumn("start", F.greatest("start", "_low")).withColumn("end", F.least("end", "_high"))
    return both.where("start < end").select(*keys, "start", "end")


def subtract(interval: Column, unsafe: Column) -> Column:
    """Fragments of a struct (start, end) outside a sorted array of such structs."""
    start = F.struct(interval["start"].alias("at"), F.array().cast("array<struct<start:double,end:double>>").alias("out"))

    def step(acc: Column, u: Column) -> Column:
        stop = F.least(u["start"], interval["end"])
        piece = F.struct(acc["at"].cast("double").alias("start"), stop.cast("double").alias("end"))
        out = F.when((u["end"] > acc["at"]) & (stop > acc["at"]), F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], F.least(u["end"], interval["end"])).alias("at"), out.alias("out"))

    rest = lambda acc: F.when(acc["at"] < interval["end"], F.concat(acc["out"], F.array(F.struct(acc["at"].cast("double").alias("start"), interval["end"].cast("double").alias("end"))))).otherwise(acc["out"])
    return F.aggregate(unsafe, start, step, rest)


def sweep(df: DataFrame, keys: list[str]) -> DataFrame:
    """Segments between successive ends with how many intervals are active there, where any is."""
    ends = df.where("start < end").select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    points = ends.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at")
    out = points.select(*keys, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("active"))
    return out.where("active > 0 and end is not null")


def split_at_midpoints(df: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """Neighbours that overlap are both cut at the middle of the overlap; too narrow results say so.

    Pairs of neighbours change different ends, so one pass over lag and lead is the sequential rule.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    prev_end, next_start = F.lag("end").over(w), F.lead("start").over(w)
    start = F.when(prev_end > F.col("start"), (prev_end + F.col("start")) / 2).otherwise(F.col("start"))
    end = F.when(next_start < F.col("end"), (F.col("end") + next_start) / 2).otherwise(F.col("end"))
    out = df.withColumn("new_start", start.cast("double")).withColumn("new_end", end.cast("double"))
    return out.withColumn("adjusted", (F.col("new_start") != F.col("start")) | (F.col("new_end") != F.col("end"))).withColumn("kept", F.col("new_end") - F.col("new_start") >= least)


def coverage(df: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """Share of [0, n) that the intervals cover."""
    m = merge(df, keys, n=n)
    return m.groupBy(*keys).agg((F.sum(F.col("end") - F.col("start")) / F.first(n)).alias("coverage"))


def grid_windows(n: Column, width: int, stride: int) -> Column:
    """Starts of the complete windows of a grid."""
    return F.when(n >= width, F.sequence(F.lit(0), (n - width).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def free_starts(starts: Column, width: int, blocked: Column) -> Column:
    """Grid starts whose window meets none of the blocked intervals."""
    return F.filter(starts, lambda s: F.forall(blocked, lambda b: (s + width <= b["start"]) | (s >= b["end"])))


def long_zero_runs_removed(signal: Column, keep: int) -> Column:
    """The signal with only the first ``keep`` samples of each run of zeros."""
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("runs"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x == 0, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.concat(acc["runs"], F.array(run)).alias("runs"))

    lengths = F.aggregate(signal, start, step, lambda acc: acc["runs"])
    return F.transform(F.filter(F.arrays_zip(signal.alias("x"), lengths.alias("r")), lambda z: z["r"] <= keep), lambda z: z["x"])
