"""Scalar expressions over columns: finiteness, intervals, hashes, bands and interval estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ["1", "true", "yes", "y"]
FALSE_WORDS = ["0", "false", "no", "n"]
Z95 = 1.959963984540054


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_float(text: Column) -> Column:
    """Text to a finite double, else null."""
    return finite(text.try_cast("double"))


def to_bool(text: Column, strict: bool = False) -> Column:
    """Yes and no words to booleans, blank to null; other words are null, or an error if ``strict``."""
    word = F.lower(F.trim(text))
    other = F.raise_error(F.concat(F.lit("not a yes or no: "), word)).cast("boolean") if strict else F.lit(None).cast("boolean")
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).when(word.isNull() | (word == ""), None).otherwise(other)


def to_count(text: Column, strict: bool = False) -> Column:
    """Text to a non-negative integer, blank to null; anything else is null, or an error if ``strict``."""
    n = F.trim(text).try_cast("int")
    other = F.raise_error(F.concat(F.lit("not a count: "), text)).cast("int") if strict else F.lit(None).cast("int")
    return F.when(F.trim(text) == "", None).when(n >= 0, n).when(text.isNotNull(), other)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def first_finite(*xs: Column) -> Column:
    """The first finite of the values, else minus infinity: a score to order by."""
    return F.coalesce(*map(finite, xs), F.lit(float("-inf")))


def passage_ms(tau: Column) -> Column:
    """Seconds to milliseconds, at least zero; null where not finite."""
    return F.greatest(F.lit(0.0), finite(tau) * 1000)


def sample_interval(t0: Column, tau: Column, n: Column, fs: float, widths: float = 2.5) -> Column:
    """Struct (start, end) in samples of a particle at ``t0`` with spread ``tau``, clipped to the trace."""
    mean = clip(t0 * fs / n, 0.0, 1.0)
    half = F.least(F.lit(0.5), clip(tau * fs / n, 0.0, 0.5) * widths)
    return F.struct((F.greatest(F.lit(0.0), mean - half) * n).alias("start"), (F.least(F.lit(1.0), mean + half) * n).alias("end"))


def intersection(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def hull_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over the hull of two intervals; zero for an empty hull."""
    return F.coalesce(F.try_divide(intersection(a0, a1, b0, b1), F.greatest(a1, b1) - F.least(a0, b0)), F.lit(0.0))


def union_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over the true union of two intervals; zero for an empty union."""
    inner = intersection(a0, a1, b0, b1)
    return F.coalesce(F.try_divide(inner, (a1 - a0) + (b1 - b0) - inner), F.lit(0.0))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Open overlap: touching intervals do not overlap."""
    return (a0 < b1) & (a1 > b0)


def contains_point(x: Column, low: Column, high: Column) -> Column:
    """Closed at both ends."""
    return (x >= low) & (x <= high)


def band(x: Column, edges: list[tuple[str, float, float]]) -> Column:
    """Name of the half-open band; what lies in none falls to the last one."""
    out = F.lit(edges[-1][0])
    for name, low, high in reversed(edges[:-1]):
        out = F.when((x >= low) & (x < high), name).otherwise(out)
    return F.when(x.isNotNull(), out)


def bin_index(x: Column, edges: list[float]) -> Column:
    """Bin by ascending edges: half-open, the last one closed; null outside."""
    out = F.when((x >= edges[-2]) & (x <= edges[-1]), len(edges) - 2)
    for i in range(len(edges) - 3, -1, -1):
        out = F.when((x >= edges[i]) & (x < edges[i + 1]), i).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null unless b is positive."""
    return F.when(b > 0, a / b)


def reduction(raw: Column, filtered: Column) -> Column:
    """1 - filtered / raw, or null unless raw is positive."""
    return F.when(raw > 0, 1 - filtered / raw)


def hash_hex(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def hash_number(digest: Column, digits: int = 16) -> Column:
    """The first hex digits of a digest as an exact number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("decimal(20,0)")


def stable_seed(*parts: Column | str) -> Column:
    return (hash_number(hash_hex(*parts)) % F.lit(4294967296).cast("decimal(20,0)")).cast("long")


def stable_shard(key: Column, shards: int) -> Column:
    return (hash_number(F.sha2(key, 256)) % F.lit(shards).cast("decimal(20,0)")).cast("int")


def blind_side(key: Column, seed: str) -> Column:
    """A or B by the parity of a digest's first byte."""
    return F.when(F.conv(F.substring(hash_hex(seed, key), 1, 2), 16, 10).cast("int") % 2 == 0, "A").otherwise("B")


def event_id(*parts: Column) -> Column:
    """Twenty hex digits of the digest of the parts."""
    return F.substring(hash_hex(*parts), 1, 20)


def wrap_phase(x: Column) -> Column:
    return F.atan2(F.sin(x), F.cos(x))


def wilson(successes: Column, total: Column, z: float = Z95) -> Column:
    """Struct (low, high) of the Wilson interval, exact at 0 and 1; null without trials."""
    p, z2 = successes / total, z * z
    mid = (p + z2 / (2 * total)) / (1 + z2 / total)
    half = z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total)) / (1 + z2 / total)
    low = F.when(successes <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half))
    high = F.when(successes >= total, 1.0).otherwise(F.least(F.lit(1.0), mid + half))
    return F.when(total > 0, F.struct(low.alias("low"), high.alias("high")))


def label_or_unclear(label: Column, snr: Column, threshold: float, missing_is_unclear: bool) -> Column:
    """Class with its reason; a missing value keeps the class or makes it unclear, as the caller's policy says."""
    known = finite(snr)
    missing = F.struct(F.lit("unclear").alias("label"), F.lit("missing_or_invalid_snr").alias("reason")) if missing_is_unclear else F.struct(label.alias("label"), F.lit("kept").alias("reason"))
    below = F.struct(F.lit("unclear").alias("label"), F.lit("below_threshold").alias("reason"))
    return F.when(known.isNull(), missing).when(known < threshold, below).otherwise(F.struct(label.alias("label"), F.lit("kept").alias("reason")))


def steady_mean(x: Column) -> Column:
    """The mean by an exact sum to ten decimals, so that neither the order nor the split of the rows changes a bit of it; the plain mean where a value has no such decimal."""
    exact = x.cast("double").try_cast("decimal(38,10)")
    return F.coalesce(F.when(F.count(exact) == F.count(x), F.try_sum(exact).cast("double") / F.count(x)), F.avg(x))


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def array_rms(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a)))


def with_value(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once for each row; a column named in a lambda is worked out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _std_about(a: Column, m: Column) -> Column:
    return F.when(F.size(a) > 0, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)))


def array_std(a: Column) -> Column:
    """Population standard deviation."""
    return with_value(array_mean(a), lambda m: _std_about(a, m))


def decimate_mean(a: Column, k: int) -> Column:
    """Means of complete blocks of k samples."""
    n = F.floor(F.size(a) / k).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: array_mean(F.slice(a, j * k + 1, F.lit(k))))
    return F.when(n > 0, blocks).otherwise(F.array().cast("array<double>"))


def z_scored(a: Column) -> Column:
    """Centred, divided by the population deviation; null for a constant array."""
    moments = with_value(array_mean(a), lambda m: F.struct(m.alias("m"), _std_about(a, m).alias("s")))
    return with_value(moments, lambda v: F.when(v.s > 0, F.transform(a, lambda x: (x - v.m) / v.s)))


def padded_crop(a: Column, center: Column, length: int) -> Column:
    """``length`` samples around ``center``, zeros where the trace has none."""
    start = center - length // 2
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.when(start + i >= 0, F.get(a, start + i)), F.lit(0.0)))


def clamped_crop(a: Column, center: Column, length: int) -> Column:
    """``length`` samples around ``center``, shifted to lie within the trace."""
    start = F.greatest(F.lit(0), F.least(F.size(a) - length, center - length // 2))
    return F.slice(a, start + 1, F.lit(length))


def gaussian_tone(n: int, fs: float, amplitude: Column, frequency: Column, sigma_s: Column, center: Column, phase: Column) -> Column:
    """Gaussian envelope times a cosine, sampled n times."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: gaussian_at(i, fs, amplitude, frequency, sigma_s, center, phase))


def gaussian_at(i: Column, fs: float, amplitude: Column, frequency: Column, sigma_s: Column, center: Column, phase: Column) -> Column:
    """Sample ``i`` of ``gaussian_tone``."""
    import math

    t = (i - center) / fs
    return amplitude * F.exp(-0.5 * F.pow(t / sigma_s, F.lit(2.0))) * F.cos(2 * math.pi * frequency * t + phase)
