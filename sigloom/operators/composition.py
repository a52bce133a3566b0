"""Long sequences composed of short traces, and noise at a requested level, as array expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import array_rms


def permutations(df: DataFrame, group: list[str], key: str, size: int) -> DataFrame:
    """Every order of each group's ``size`` members, as ``order`` with its number; groups of another size give none.

    The orders are a fixed table of factorial(size) rows.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(map(list, itertools.permutations(range(size))))), "permutation int, places array<int>")
    members = df.groupBy(*group).agg(F.array_sort(F.collect_set(key)).alias("_m")).where(F.size("_m") == size)
    return members.crossJoin(F.broadcast(table)).select(*group, "permutation", F.transform("places", lambda i: F.get("_m", i)).alias("order"))


def concatenated(segments: DataFrame, keys: list[str], position: str, signal: str, events: str, length: int) -> DataFrame:
    """Segments of equal length in order of ``position`` as one trace, their events shifted to where they now lie."""
    part = F.struct(F.col(position).alias("p"), F.col(signal).alias("x"), F.col(events).alias("e"))
    parts = F.array_sort(F.collect_list(part), lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))
    shift = lambda q, i: F.transform(q["e"], lambda v: v.withField("start", v["start"] + i * length).withField("end", v["end"] + i * length))
    return segments.groupBy(*keys).agg(parts.alias("_p")).select(*keys, F.flatten(F.transform("_p", lambda q: q["x"])).alias("signal"), F.flatten(F.transform("_p", shift)).alias("events"))


def smoothed_joins(signal: Column, length: int, count: int, fade: int) -> Column:
    """A straight ramp over ``fade`` samples on either side of each join, in place of the step."""
    out = signal
    for k in range(1, count):
        at, before = k * length, out
        a, b = F.get(before, F.lit(at - fade)), F.get(before, F.lit(at + fade - 1))

        def ramp(x: Column, i: Column, at: int = at, a: Column = a, b: Column = b) -> Column:
            return F.when((i >= at - fade) & (i < at + fade), a + (b - a) * (i - (at - fade)) / max(1, 2 * fade - 1)).otherwise(x)

        out = F.transform(before, _two(ramp))
    return out


def _two(f):
    return lambda x, i: f(x, i)


def with_noise(clean: Column, noise: Column, snr_db: Column) -> Column:
    """Clean trace plus a noise trace scaled to the requested ratio of their RMS; null where the noise is silent."""
    scale = F.try_divide(array_rms(clean), array_rms(noise) * F.pow(F.lit(10.0), snr_db / 20.0))
    return F.when(scale.isNotNull(), F.zip_with(clean, noise, lambda a, b: a + b * scale))


def guarded_edges(signal: Column, noise: Column, pad: int) -> Column:
    """The trace with noise in its first and last ``pad`` samples."""
    n = F.size(signal)
    return F.transform(signal, lambda x, i: F.when((i < pad) | (i >= n - pad), F.coalesce(F.get(noise, i), x)).otherwise(x))


def edge_safe(events: Column, n: Column, pad: int) -> Column:
    """Events that keep clear of both padded edges."""
    return F.filter(events, lambda e: (e["start"] >= pad) & (e["end"] <= n - pad))


def snr_db(signal: Column, start: Column, end: Column) -> Column:
    """Level inside an interval over the level outside it; either is at least 1e-12."""
    inside = F.slice(signal, start + 1, end - start)
    outside = F.filter(signal, lambda x, i: (i < start) | (i >= end))
    level = lambda a: F.greatest(F.coalesce(array_rms(a), F.lit(0.0)), F.lit(1e-12))
    return 20 * F.log10(level(inside) / level(outside))


def particle_mask(n: int, intervals: Column) -> Column:
    """True for each sample that an interval covers."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exists(intervals, lambda v: (i >= v["start"]) & (i < v["end"])))
