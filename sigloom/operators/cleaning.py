"""Non-destructive cleaning of traces: saturated stretches are replaced, masked or only reported.

Spans and carriers are tables; they are gathered by trace (spans of a trace are disjoint, so
that its length bounds them) and meet the traces in a join on the key. Masking is an expression;
repairs filter and blend in Arrow batches, a trace at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.expr import stable_shard
from .detectors import Detection

POLICIES = ("replace", "mask", "keep")
_ACTIONS = {"replace": "replaced", "mask": "masked", "keep": "reported"}


def response_radius(c: Detection, n: int = 16384, share: float = 0.999) -> int:
    """How many samples to either side of a pulse hold ``share`` of the zero-phase filter's absolute response."""
    pulse = np.zeros(n)
    pulse[n // 2] = 1.0
    size = np.abs(dsp.zero_phase(dsp.butter_bandpass(c.low, c.high, c.order, c.fs), pulse[None])[0])
    half = n - 1 - n // 2
    rings = np.r_[size[n // 2], size[n // 2 + 1 :] + size[n // 2 - half : n // 2][::-1]]
    return int(min(np.searchsorted(np.cumsum(rings), share * size.sum()), len(rings) - 1))


def actions(spans: DataFrame, key: str, policy: str) -> DataFrame:
    """``(key, nth, start, end, length, action)``: what the policy does with each span, numbered from 0 in order."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("start", "end")) - 1
    return spans.select(key, nth.alias("nth"), "start", "end", (F.col("end") - F.col("start")).alias("length"), F.lit(_ACTIONS[policy]).alias("action"))


def masked(signal: Column, spans: Column, value: float = 0.0) -> Column:
    """A trace with ``value`` wherever one of its spans (start, end; half-open) is; null spans change nothing."""
    inside = lambda i: F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"]))
    return F.when(spans.isNull() | (F.size(spans) == 0), signal).otherwise(F.transform(signal, lambda x, i: F.when(inside(i), F.lit(value)).otherwise(x)))


def with_carriers(spans: DataFrame, pool: DataFrame, key: str, seed: str, size: int) -> DataFrame:
    """Spans with a noise carrier of their length from ``pool(number, noise)``, numbered 0 to size - 1: chosen and placed by digest.

    A carrier that is too short is repeated; an empty one leaves zeros.
    """
    told = F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("start").cast("string"))
    numbered = spans.withColumn("number", stable_shard(told, size)).withColumn("_length", F.col("end") - F.col("start"))
    joined = numbered.join(pool.select("number", "noise"), "number", "left")
    have = F.coalesce(F.size("noise"), F.lit(0))
    room = F.greatest(have - F.col("_length"), F.lit(0)) + 1
    first = F.pmod(F.xxhash64(told), room)
    at = lambda i: F.get(F.col("noise"), F.pmod(first + i, F.greatest(have, F.lit(1))).cast("int"))
    carrier = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_length") - 1, F.lit(0)).cast("int")), lambda i: F.coalesce(at(i), F.lit(0.0)))
    return joined.withColumn("carrier", carrier).drop("number", "noise", "_length")


def replaced(traces: DataFrame, spans: DataFrame, key: str, signal: str) -> DataFrame:
    """``traces`` with ``clean``: the signal with every span's carrier in its place (spans from ``with_carriers``)."""
    gathered = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "carrier"))).alias("_spans"))
    joined = traces.join(gathered, key, "left")
    x, s, n = F.col(signal), F.col("_spans"), F.size("_spans")

    def piece(i: Column) -> Column:
        one = F.get(s, i)
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end"]).cast("int")
        return F.concat(F.slice(x, before + 1, F.greatest(one["start"].cast("int") - before, F.lit(0))), one["carrier"])

    rest = F.slice(x, F.get(s, n - 1)["end"].cast("int") + 1, F.greatest(F.size(x) - F.get(s, n - 1)["end"].cast("int"), F.lit(0)))
    clean = F.concat(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), piece)), rest)
    return joined.withColumn("clean", F.when(s.isNull(), x).otherwise(clean)).drop("_spans")


_REPAIRED = "clean array<double>, filtered array<double>, regions int, problem string"


def repaired(traces: DataFrame, regions: DataFrame, key: str, signal: str, config: Detection = Detection(), domain: str = "signal") -> DataFrame:
    """``(key, clean, filtered, regions, problem)``: saturated regions blended over by raised cosines, and the band-passed trace.

    regions(key, core_start, core_end, outer_start, outer_end, carrier): the carrier spans the outer interval, and
    replaces the core whole. domain ``signal`` blends first and filters once; ``filtered`` filters the trace and each
    carrier by themselves and blends what comes out, so that no repair changes what lies beyond it. A trace whose outer
    intervals overlap, leave it, or don't fit their carriers is given as it is, and ``problem`` says so.
    """
    if domain not in ("signal", "filtered"):
        raise ValueError("domain must be signal or filtered")
    fields = ("outer_start", "outer_end", "core_start", "core_end", "carrier")
    gathered = regions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_regions"))
    joined = traces.select(key, F.col(signal).alias("_signal")).join(gathered, key, "left").select(key, "_signal", "_regions")

    def fault(x: np.ndarray, rows: list[dict]) -> str | None:
        ends = np.array([[r[f] for f in fields[:4]] for r in rows], np.int64).reshape(-1, 4)
        nested = (ends[:, 0] <= ends[:, 2]) & (ends[:, 2] <= ends[:, 3]) & (ends[:, 3] <= ends[:, 1]) & (ends[:, 0] >= 0) & (ends[:, 1] <= len(x))
        if (ends[1:, 0] < ends[:-1, 1]).any():
            return "overlap"
        if not nested.all():
            return "outside"
        return None if all(len(r["carrier"] or ()) == r["outer_end"] - r["outer_start"] for r in rows) else "carrier"

    def bands(arrays: list[np.ndarray]) -> list[np.ndarray]:
        """Band-passed arrays; those of one length are filtered together."""
        sos = dsp.butter_bandpass(config.low, config.high, config.order, config.fs)
        out: list = [None] * len(arrays)
        by: dict[int, list[int]] = {}
        for i, x in enumerate(arrays):
            by.setdefault(len(x), []).append(i)
        for at in by.values():
            for i, y in zip(at, dsp.zero_phase(sos, np.stack([arrays[i] for i in at]))):
                out[i] = y
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                told = [(i, x, rows or []) for i, (x, rows) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())) if x and None not in x]
                signals = [np.asarray(x, np.float64) for _, x, _ in told]
                problems = [fault(x, rows) for x, (_, _, rows) in zip(signals, told)]
                work = [(n, r, np.asarray(r["carrier"], np.float64)) for n, (_, _, rows) in enumerate(told) if not problems[n] for r in rows]
                clean, through = list(signals), bands(signals) if domain == "filtered" else []
                for (n, r, carrier), band in zip(work, bands([c for *_, c in work]) if domain == "filtered" else [None] * len(work)):
                    core, outer = (r["core_start"], r["core_end"]), (r["outer_start"], r["outer_end"])
                    clean[n] = dsp.blend(clean[n], carrier, core, outer)
                    if domain == "filtered":
                        through[n] = dsp.blend(through[n], band, core, outer)
                through = through if domain == "filtered" else bands(clean)
                cols = [pa.array(clean, pa.list_(pa.float64())), pa.array(through, pa.list_(pa.float64())), pa.array([len(rows) for *_, rows in told], pa.int32()), pa.array(problems, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i for i, *_ in told], pa.int32())), *cols], names=[key, "clean", "filtered", "regions", "problem"])

    return joined.mapInArrow(run, f"{key} {joined.schema[key].dataType.simpleString()}, {_REPAIRED}")
