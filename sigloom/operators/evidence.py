"""Evidence for single events: coherence of phases, isolation of the spectrum, periodicity, and edges on the envelope.

All are maps over traces in Arrow batches. A trace brings its events as an array of spans; spans of one length are stacked,
so that a batch takes one transform for each length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import dsp
from .detectors import Detection, active_groups, filtered, islands, map_traces, widened

Span = tuple[int, int, int]


def spans_of(events: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``(key, spans)``: the events of each trace as an array of ``(start, end)`` in order; a row for each trace with events."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(start).cast("int").alias("start"), F.col(end).cast("int").alias("end")))).alias("spans"))


def map_spans(df: DataFrame, key: str, signal: str, spans: str, schema: str, f: Callable[[list[np.ndarray], list[tuple[int, Span]]], list[dict]]) -> DataFrame:
    """Rows (key, span, start, end, ...) that ``f`` makes of the traces of a batch and their spans ``(trace, (number, start, end))``.

    Spans are clamped to the trace; null or empty ones give no rows, nor do null, empty and non-finite traces.
    """
    made_of = T.StructType.fromDDL(f"span int, start int, end int, {schema}")
    types = {field.name: field.type for field in to_arrow_schema(made_of)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            traces = [np.empty(0) if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.float64) for v in b.column(1)]
            used = []
            for i, (x, given) in enumerate(zip(traces, b.column(2).to_pylist())):
                if not len(x) or not np.isfinite(x).all():
                    continue
                for k, s in enumerate(given or []):
                    if s is not None and s["start"] is not None and s["end"] is not None:
                        lo, hi = max(0, s["start"]), min(len(x), s["end"])
                        if lo < hi:
                            used.append((i, (k, lo, hi)))
            if not used:
                continue
            made = f(traces, used)
            cols = {key: b.column(0).take(pa.array([i for i, _ in used]))}
            for at, name in enumerate(("span", "start", "end")):
                cols[name] = pa.array([s[at] for _, s in used], types[name])
            for name in list(types)[3:]:
                cols[name] = pa.array([d[name] for d in made], types[name])
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return df.select(key, signal, spans).mapInArrow(run, T.StructType([df.schema[key], *made_of.fields]))


def isolation(x: np.ndarray, side: tuple[float, float] = (1 / 8, 1 / 4)) -> tuple[np.ndarray, np.ndarray]:
    """Of stacked segments: the strongest bin's share of all power, and its ratio to the mean of its side bands.

    Side bands are the bins between both shares of all bins away from the strongest, on either side; a chirp stays inside them.

    A silent segment, or one of fewer than 16 samples, has a share of one; the ratio is nan where the side bands are empty.
    """
    rows, n = x.shape
    share, ratio = np.ones(rows), np.full(rows, np.nan)
    if n < 16:
        return share, ratio
    p = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * dsp.hann(n, periodic=False), axis=1)) ** 2
    total, top = p.sum(1), p.argmax(1)
    best = p[np.arange(rows), top]
    share = np.divide(best, total, out=share, where=total > 0)
    away = np.abs(np.arange(p.shape[1])[None, :] - top[:, None])
    beside = (away >= max(3, side[0] * p.shape[1])) & (away <= side[1] * p.shape[1])
    mean = np.divide((p * beside).sum(1), beside.sum(1), out=np.zeros(rows), where=beside.any(1))
    return share, np.divide(best, mean, out=ratio, where=mean > 0)


def periodicity(x: np.ndarray) -> np.ndarray:
    """Of stacked segments: the greatest absolute autocorrelation from a twentieth of the length (two samples at least) on, by a padded transform.

    A silent segment, or one of fewer than 24 samples, counts as wholly periodic (one).
    """
    rows, n = x.shape
    out = np.ones(rows)
    if n < 24:
        return out
    d = x - x.mean(1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    c = np.fft.irfft(np.abs(np.fft.rfft(d, size, axis=1)) ** 2, size, axis=1)[:, :n]
    power = (d * d).sum(1)
    return np.divide(np.abs(c[:, max(2, n // 20) :]).max(1), power, out=out, where=power > 0)


def spectral_evidence(df: DataFrame, key: str, signal: str, spans: str = "spans", least_share: float = 0.12, least_period: float = 0.5, least_ratio: float = 20.0) -> DataFrame:
    """``(key, span, start, end, isolation, side_ratio, periodicity, kind)`` for each event.

    ``tone``: isolated and periodic. ``noise_like``: neither isolated nor periodic, and the strongest bin
    doesn't rise over its side bands by ``least_ratio``. ``chirp``: anything between.
    """

    def f(traces: list[np.ndarray], used: list[tuple[int, Span]]) -> list[dict]:
        out: list[dict] = [{}] * len(used)
        by: dict[int, list[int]] = {}
        for j, (_, (_, lo, hi)) in enumerate(used):
            by.setdefault(hi - lo, []).append(j)
        for rows in by.values():
            x = np.stack([traces[used[j][0]][used[j][1][1] : used[j][1][2]] for j in rows])
            for j, share, ratio, period in zip(rows, *isolation(x), periodicity(x)):
                clear, regular = share >= least_share, period >= least_period
                beside = bool(np.isfinite(ratio)) and ratio >= least_ratio
                kind = "tone" if clear and regular else "noise_like" if not (clear or regular or beside) else "chirp"
                out[j] = {"isolation": float(share), "side_ratio": float(ratio) if np.isfinite(ratio) else None, "periodicity": float(period), "kind": kind}
        return out

    return map_spans(df, key, signal, spans, "isolation double, side_ratio double, periodicity double, kind string", f)


def outward(z: np.ndarray, start: int, end: int, level: float, most: int) -> tuple[int, int]:
    """The span widened on both sides while z holds the level, by ``most`` samples at most."""
    low = np.flatnonzero(z[max(0, start - most) : start] < level)
    high = np.flatnonzero(z[end : end + most] < level)
    left = max(0, start - most) + (int(low[-1]) + 1 if len(low) else 0)
    right = end + int(high[0]) if len(high) else min(len(z), end + most)
    return left, right


def extended_spans(df: DataFrame, key: str, signal: str, spans: str = "spans", config: Detection = Detection(), level: float = 2.0, smooth_ms: float = 0.02, most_ms: float = 0.4) -> DataFrame:
    """``(key, span, start, end, new_start, new_end, grown)``: edges moved outward on the smoothed analytic envelope of the filtered trace.

    An edge moves while the envelope's robust z is ``level`` or more, ``most_ms`` at most; it never moves in.
    """
    width, most = max(1, round(smooth_ms / 1000 * config.fs)), round(most_ms / 1000 * config.fs)

    def f(traces: list[np.ndarray], used: list[tuple[int, Span]]) -> list[dict]:
        at = sorted({i for i, _ in used})
        by: dict[int, list[int]] = {}
        for i in at:
            by.setdefault(len(traces[i]), []).append(i)
        z = {}
        for rows in by.values():
            for i, env in zip(rows, dsp.envelope(filtered(np.stack([traces[i] for i in rows]), config))):
                z[i] = dsp.robust_z(dsp.moving_average(env, width, zero_padded=False))
        made = [outward(z[i], lo, hi, level, most) for i, (_, lo, hi) in used]
        return [{"new_start": a, "new_end": b, "grown": (a, b) != (lo, hi)} for (a, b), (_, (_, lo, hi)) in zip(made, used)]

    return map_spans(df, key, signal, spans, "new_start int, new_end int, grown boolean", f)


def in_region(center: Column, start: Column, end: Column, region_start: Column, region_end: Column) -> Column:
    """Whether a candidate belongs to a region: they share samples and its centre lies in the region."""
    return (F.least(end, region_end) > F.greatest(start, region_start)) & center.between(region_start, region_end)


@dataclass(frozen=True)
class Grades:
    """What the three grades of an event ask for. The defaults are fixed values, but for the coherence of strict ones."""

    medium_z: float = 12.0
    strict_z: float = 12.0
    medium_concentration: float = 0.08
    strict_concentration: float = 0.12
    strict_coherence: float = 0.5
    peak_height: float = 0.2
    peak_prominence: float = 0.08
    min_ms: float = 0.06
    max_ms: float = 2.0


def coherence(spec: np.ndarray) -> tuple[float | None, float | None]:
    """Of complex spectra (peaks, frames), strongest first: how alike the phase's steps in time are, and the phases between the two strongest.

    None below two frames, and for the second below two peaks. Frames of zero count as phase zero.
    """
    if spec.shape[1] < 2 or not len(spec):
        return None, None
    size = np.abs(spec)
    unit = np.divide(spec, size, out=np.ones_like(spec), where=size > 0)
    steps = float(np.abs((unit[:, 1:] * unit[:, :-1].conj()).mean(1)).mean())
    return steps, float(np.abs((unit[0] * unit[1].conj()).mean())) if len(spec) > 1 else None


def coherent_events(df: DataFrame, key: str, signal: str, config: Detection = Detection(), grades: Grades = Grades()) -> DataFrame:
    """Events by excess energy, with their strongest frequencies, the coherence of their phases over several of them, and a grade.

    The complex spectrum is kept; up to three peaks of an event's excess power, by prominence, take part.
    ``coherence`` is the mean of the two of ``coherence``; where it is unknown it does not stand against ``strict``.
    """
    c, g = config, grades

    def one(x: np.ndarray) -> list[dict]:
        freq, _, spec = dsp.stft(x, c.fs, c.width, c.hop)
        keep = (freq >= c.low) & (freq <= c.high)
        freq, spec = freq[keep], spec[keep]
        if not spec.size:
            return []
        power = np.abs(spec) ** 2
        excess = np.maximum(power - np.quantile(power, c.baseline, axis=1, keepdims=True), 0)
        energy = dsp.moving_average(excess.sum(0), c.smooth, zero_padded=False)
        z = dsp.robust_z(energy)
        out = []
        for a, b in islands(widened(active_groups(z >= c.threshold, c.max_gap), z, c.boundary)).tolist():
            p = excess[:, a : b + 1].sum(1)
            total, top = float(p.sum()), float(p.max())
            if total <= 0:
                continue
            peaks = dsp.find_peaks(p, height=g.peak_height * top, prominence=g.peak_prominence * top)
            peaks = peaks if len(peaks) else np.array([int(p.argmax())])
            peaks = peaks[np.argsort(-p[peaks], kind="stable")]
            steps, between = coherence(spec[peaks[:3], a : b + 1])
            known = [v for v in (steps, between) if v is not None]
            mean = float(np.mean(known)) if known else None
            start, end = max(0, a * c.hop - c.pad), min(len(x), b * c.hop + c.width + c.pad)
            weight = np.maximum(energy[a : b + 1] - np.median(energy), 0)
            frames = np.arange(a, b + 1) * c.hop + c.width // 2
            middle = float((frames * weight).sum() / weight.sum()) if weight.sum() > 0 else float(frames.mean())
            ms, best = (end - start) / c.fs * 1000, float(z[a : b + 1].max())
            share = float(np.sort(p)[-c.top_bins :].sum() / total)
            if ms < g.min_ms or ms > g.max_ms:
                grade, reason = "reject", "below_min_width" if ms < g.min_ms else "above_max_width"
            elif best >= g.strict_z and share >= g.strict_concentration and (mean is None or mean >= g.strict_coherence):
                grade, reason = "strict", ""
            elif best >= g.medium_z and share >= g.medium_concentration:
                grade, reason = "medium", ""
            else:
                grade, reason = "reject", "below_quality"
            out.append({
                "event": len(out), "start": start, "end": end, "center": round(middle), "width_ms": ms, "z": best, "concentration": share, "peaks": len(peaks),
                "frequency": float(freq[peaks[0]]), "low_peak": float(freq[peaks].min()), "high_peak": float(freq[peaks].max()),
                "in_time": steps, "between": between, "coherence": mean, "quality": grade, "reason": reason,
            })
        return out

    schema = "event int, start int, end int, center int, width_ms double, z double, concentration double, peaks int, frequency double, low_peak double, high_peak double, in_time double, between double, coherence double, quality string, reason string"
    return map_traces(df, key, signal, schema, lambda x, _: [one(v) for v in filtered(x, c)])


def count_guard(rows: DataFrame, reference: DataFrame, group: str, unit: str, least: int = 2, share: float = 0.99) -> DataFrame:
    """``(group, unit, n, limit, suspect)``: units with more rows than the ``share`` percentile of the reference's units of their group.

    The limit is rounded up and ``least`` at least, also where the reference has no unit of the group. Percentiles
    come from counts of counts, so that no group of units is sorted in one task.
    """
    sizes = reference.where(F.col(group).isNotNull()).groupBy(group, unit).agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.groupBy(group, "n").agg(F.count(F.lit(1)).alias("k"))
    limit = F.ceil(F.percentile("n", F.lit(share), F.col("k")))
    limits = counts.groupBy(group).agg(F.greatest(limit, F.lit(least)).cast("long").alias("limit"))
    told = rows.where(F.col(group).isNotNull()).groupBy(group, unit).agg(F.count(F.lit(1)).alias("n"))
    known = told.join(limits, group, "left").withColumn("limit", F.coalesce("limit", F.lit(least).cast("long")))
    return known.select(group, unit, "n", "limit", (F.col("n") > F.col("limit")).alias("suspect"))
