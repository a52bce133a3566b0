"""Bounded least squares over stacked traces, and nested models of an event's envelope.

``bounded_least_squares`` solves many small problems at once: damped Gauss-Newton steps with
bounds kept by projection, every problem with its own damping and its own end. Traces are
independent, so fitting is a map over Arrow batches without an exchange.
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

Model = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _cost(r: np.ndarray, soft: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Cost of each problem, and the weights of its residuals; ``soft`` is where large ones begin to count linearly.

    The weights are those of a parabola above the loss that touches it here, so that a step to its foot goes down.
    """
    if soft is None:
        return 0.5 * (r * r).sum(1), np.ones_like(r)
    z = 1 + (r / soft) ** 2
    return soft * soft * (np.sqrt(z) - 1).sum(1), z**-0.5


def bounded_least_squares(model: Model, start: np.ndarray, low: np.ndarray, high: np.ndarray, soft: float | None = None, rounds: int = 400, tol: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """(problems, parameters) of least cost within bounds, and the costs.

    ``model(x, which)`` gives residuals (problems, points) and their derivatives (problems, points, parameters)
    of the problems ``which``. A parameter at a bound that the gradient pushes
    outwards is held there for the step; a step beyond a bound ends on it. A problem leaves the
    stack once three steps in a row lower its cost by no more than ``tol`` of it.
    """
    x = np.clip(start, low, high)
    which = np.arange(len(x))
    r, jac = model(x, which)
    jac = jac.transpose(0, 2, 1)  # products run along the points
    cost, w = _cost(r, soft)
    out, best = x.copy(), cost.copy()
    damp = np.full(len(x), 1e-1)
    still = np.zeros(len(x), np.int64)
    p = x.shape[1]
    for _ in range(rounds):
        if not len(which):
            break
        g = (jac @ (w * r)[:, :, None])[:, :, 0]
        h = (jac * w[:, None, :]) @ jac.transpose(0, 2, 1)
        held = ((x <= low[which]) & (g > 0)) | ((x >= high[which]) & (g < 0))
        g[held] = 0
        h[held[:, :, None] | held[:, None, :]] = 0
        d = np.einsum("bpp->bp", h)  # a view of the diagonals
        scale = np.maximum(d, 1e-3 * np.maximum(d.max(1, keepdims=True), 1e-300))
        h = h + np.eye(p) * (damp[:, None] * scale + held)[:, None, :]
        step = np.clip(x - np.linalg.solve(h, g[:, :, None])[:, :, 0], low[which], high[which]) - x
        r2, jac2 = model(x + step, which)
        cost2, w2 = _cost(r2, soft)
        good = np.isfinite(cost2) & (cost2 <= cost)
        small = (np.abs(step) <= 1e-9 * (1e-3 + np.abs(x))).all(1)
        still = np.where(small | (good & (cost - cost2 <= tol * cost)), still + 1, 0)
        x = np.where(good[:, None], x + step, x)
        cost = np.where(good, cost2, cost)
        jac2 = jac2.transpose(0, 2, 1)
        if good.all():
            r, w, jac = r2, w2, jac2
        elif good.any():
            r, w = (np.where(good[:, None], b, a) for a, b in ((r, r2), (w, w2)))
            jac = np.where(good[:, None, None], jac2, jac)
        damp = np.clip(np.where(good, damp / 5, damp * 4), 1e-12, 1e12)
        out[which], best[which] = x, cost
        go = (still < 3) & (damp < 1e12) & (cost > 0)
        if not go.all():
            which, x, r, jac, cost, w, damp, still = (a[go] for a in (which, x, r, jac, cost, w, damp, still))
    return out, best


def lobes(t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of two-sided lobes at times (problems, points), with derivatives by parameter.

    Five parameters a lobe: log height a, centre, log widths to the left and right, and exponent s
    of exp(a - (|t - centre| / width) ** s / 2).
    """
    value, parts = np.zeros_like(t), np.zeros((len(t), x.shape[1], t.shape[1]))
    for k in range(0, x.shape[1], 5):
        a, mid, left, right, s = (x[:, k + i, None] for i in range(5))
        before = t < mid
        width = np.where(before, np.exp(left), np.exp(right))
        d = np.abs(t - mid) / width
        away = d > 0
        everywhere = away.all()
        far = d if everywhere else np.where(away, d, 1.0)
        log_d = np.log(far)
        ds = np.exp(s * log_d)
        if not everywhere:
            ds[~away] = 0
        v = np.exp(a - 0.5 * ds)
        pull = 0.5 * s * v * ds  # minus the derivative by log d; zero where d is
        by_mid = pull / far / width
        parts[:, k] = v
        parts[:, k + 1] = np.negative(by_mid, out=by_mid, where=before)
        np.copyto(parts[:, k + 2], pull, where=before)
        np.copyto(parts[:, k + 3], pull, where=~before)
        parts[:, k + 4] = -0.5 * v * ds * log_d
        value += v
    return value, parts.transpose(0, 2, 1)


@dataclass(frozen=True)
class EnvelopeFit:
    """Parameters of the envelope fit; times in milliseconds. The defaults are fixed values."""

    fs: float = 2_000_000.0
    pad_ms: float = 0.25
    points: int = 512
    least_points: int = 128
    smooth: int = 32
    soft: float = 0.05
    width_ms: tuple[float, float] = (0.015, 0.8)
    exponent: tuple[float, float] = (1.0, 4.0)
    apart_ms: tuple[float, ...] = (0.08, 0.18, 0.36)
    ratios: tuple[float, ...] = (0.45, 0.80)
    trial: tuple[int, int, int] = (12, 4, 2)  # rounds that all guesses get on every so manieth point, and how many go on
    rounds: int = 120
    tol: float = 1e-9


LOBE = "height double, center_ms double, left_ms double, right_ms double, shape double, area double"
FIT = f"n_points int, start_ms double, end_ms double, bic1 double, bic2 double, residual1 double, residual2 double, one struct<{LOBE.replace(' double', ':double')}>, two array<struct<{LOBE.replace(' double', ':double')}>>, error string"


def smoothed_envelope(x: np.ndarray, width: int) -> np.ndarray:
    """Magnitude of the analytic signal over a sliding mean of ``width`` samples, end values repeated."""
    e = np.abs(dsp.analytic(x))
    e = np.concatenate([np.repeat(e[:, :1], width // 2, 1), e, np.repeat(e[:, -1:], width - 1 - width // 2, 1)], 1)
    total = np.concatenate([np.zeros((len(e), 1)), np.cumsum(e, 1)], 1)
    return (total[:, width:] - total[:, :-width]) / width


def support(envelope: np.ndarray, start: float, end: float, c: EnvelopeFit) -> tuple[np.ndarray, np.ndarray] | None:
    """Times in ms and heights over the baseline at the points of a fit; None where the padded event is too short."""
    n = len(envelope)
    pad = round(c.pad_ms * 1e-3 * c.fs)
    a, b = max(0, int(np.floor(start)) - pad), min(n, int(np.ceil(end)) + pad)
    if b - a < c.least_points:
        return None
    at = np.unique(np.linspace(a, b - 1, min(c.points, b - a)).round().astype(int))
    outside = np.ones(n, bool)
    outside[max(0, int(np.floor(start))) : max(0, min(n, int(np.ceil(end))))] = False
    base = np.median(envelope[outside]) if outside.any() else np.quantile(envelope, 0.25)
    return at / c.fs * 1000.0, np.maximum(envelope[at] - base, 0.0)


def starts(t: np.ndarray, e: np.ndarray, c: EnvelopeFit) -> tuple[list[list[float]], list[list[float]]]:
    """First guesses for one lobe and for two: the highest point; the two most prominent peaks, and pairs about the highest point."""
    top, mid = float(e.max()), float(t[e.argmax()])

    def lobe(height: float, at: float, width: float) -> list[float]:
        return [np.log(max(height, 1e-8)), at, np.log(width), np.log(width), 2.0]

    two = []
    peaks = dsp.find_peaks(e, distance=max(1, round(0.06 / float(np.median(np.diff(t))))), prominence=max(0.04 * top, 1e-9))
    if len(peaks) > 1:
        strong = np.sort(peaks[np.argsort(-dsp.prominences(e, peaks), kind="stable")[:2]])
        two.append([v for i in strong for v in lobe(float(e[i]), float(t[i]), 0.14)])
    for apart in c.apart_ms:
        for ratio in c.ratios:
            two.append(lobe(top, mid - apart / 2, 0.16) + lobe(ratio * top, mid + apart / 2, 0.16))
    return [lobe(top, mid, 0.18)], two


def _solve(t: np.ndarray, e: np.ndarray, guesses: list[list[list[float]]], c: EnvelopeFit) -> list[tuple[np.ndarray, float]]:
    """The best fit of each trace from its guesses, and its sum of squares.

    All guesses of all traces are one stack. They are first tried on a part of the points for a few
    rounds; of each trace the ones that lead then go on over all points.
    """
    owner = np.array([i for i, g in enumerate(guesses) for _ in g])
    x = np.array([x for g in guesses for x in g])
    k, top = x.shape[1] // 5, e.max(1)
    bounds = [(np.log(np.maximum(top * 0.01, 1e-8)), np.log(np.maximum(top * 2.5, 1e-7))), (t[:, 0], t[:, -1]), *[(np.log(w), np.log(v)) for w, v in [c.width_ms] * 2], c.exponent]
    low, high = (np.tile(np.stack([np.broadcast_to(b[side], len(top)) for b in bounds], 1), (1, k)) for side in (0, 1))

    def fitted(x: np.ndarray, owner: np.ndarray, every: int, rounds: int) -> np.ndarray:
        def model(x: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            o = owner[which]
            v, jac = lobes(t[o, ::every], x)
            unit = np.maximum(top[o], 1e-9)[:, None]
            jac /= unit[:, :, None]
            return (v - e[o, ::every]) / unit, jac

        return bounded_least_squares(model, np.clip(x, low[owner] + 1e-8, high[owner] - 1e-8), low[owner], high[owner], c.soft, rounds, c.tol)[0]

    def ranked(x: np.ndarray, owner: np.ndarray, most: int) -> list[int]:
        rss = ((lobes(t[owner], x)[0] - e[owner]) ** 2).sum(1)
        return [j for i in range(len(guesses)) for j in sorted(np.flatnonzero(owner == i), key=lambda m: (rss[m], tuple(x[m])))[:most]]

    rounds, every, most = c.trial
    if len(owner) > len(guesses):
        x = fitted(x, owner, every, rounds)
        lead = ranked(x, owner, most)
        x, owner = x[lead], owner[lead]
    x = fitted(x, owner, 1, c.rounds)
    best = x[ranked(x, owner, 1)]
    return [(v, float(r)) for v, r in zip(best, ((lobes(t, best)[0] - e) ** 2).sum(1))]


def fit_stack(t: np.ndarray, e: np.ndarray, c: EnvelopeFit = EnvelopeFit()) -> list[dict]:
    """Fits of one and of two lobes to heights (traces, points), with their information criteria."""
    n = t.shape[1]
    told = [starts(t[i], e[i], c) for i in range(len(t))]
    made = [{"n_points": n, "start_ms": float(t[i, 0]), "end_ms": float(t[i, -1]), "error": None} for i in range(len(t))]
    for k, name in ((0, "1"), (1, "2")):
        for i, (x, rss) in enumerate(_solve(t, e, [g[k] for g in told], c)):
            rss = max(rss, 1e-18)
            out = [{"height": float(np.exp(v[0])), "center_ms": float(v[1]), "left_ms": float(np.exp(v[2])), "right_ms": float(np.exp(v[3])), "shape": float(v[4]), "area": float(np.trapezoid(lobes(t[i : i + 1], v[None])[0][0], t[i]))} for v in x.reshape(-1, 5)]
            out.sort(key=lambda v: (-v["area"], v["center_ms"]))
            made[i] |= {"bic" + name: float(n * np.log(rss / n) + len(x) * np.log(n)), "residual" + name: float(np.sqrt(rss / max((e[i] ** 2).sum(), 1e-18))), **({"one": out[0]} if name == "1" else {"two": out})}
    return made


def envelope_fits(traces: DataFrame, key: str, signal: str, start: str, end: str, c: EnvelopeFit = EnvelopeFit(), batch: int = 16) -> DataFrame:
    """One row for each event: the fits of one lobe and of two to its envelope over the baseline, beside their criteria.

    Every row is answered: ``error`` says why one has no fit (``signal`` null, empty or not finite,
    ``support`` missing or too short, ``flat`` without any height), and the fit is null then. Traces
    may differ in length; events of one number of points are solved together.
    """
    made_of = T.StructType.fromDDL(FIT)
    shape = to_arrow_schema(made_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, a, z = b.column(1), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            out: list[dict] = [{"error": "signal"} for _ in range(b.num_rows)]
            by: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
            for i in range(b.num_rows):
                v = column[i].values
                v = v.to_numpy(zero_copy_only=False).astype(np.float64) if v is not None else np.empty(0)
                if not len(v) or not np.isfinite(v).all():
                    continue
                ends = [float(x) if x is not None else np.nan for x in (a[i], z[i])]
                got = support(smoothed_envelope((v - v.mean())[None], c.smooth)[0], *ends, c) if np.isfinite(ends).all() else None
                if got is None or not got[1].max() > 0:
                    out[i] = {"error": "support" if got is None else "flat"}
                else:
                    by.setdefault(len(got[0]), []).append((i, *got))
            for group in by.values():
                for at in range(0, len(group), batch):
                    part = group[at : at + batch]
                    for (i, *_), made in zip(part, fit_stack(np.stack([p[1] for p in part]), np.stack([p[2] for p in part]), c)):
                        out[i] = made
            columns = [pa.array([d.get(f.name) for d in out], f.type) for f in shape]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[key, *shape.names])

    rows = traces.select(key, F.col(signal).cast("array<double>"), F.col(start).cast("double"), F.col(end).cast("double"))
    return rows.mapInArrow(run, T.StructType([traces.schema[key], *made_of.fields]))


def compared(fits: DataFrame, least_bic: float = 10.0, least_resolved: float = 0.1) -> DataFrame:
    """``fits`` with what tells both models apart: delta_bic, resolvability, the two lobes in order of time, resolved, weight and reason.

    Resolvability is distance over mean width, times the ratio of heights, times the
    certainty that two lobes are needed. Widths and distances are in units of the first lobe.
    """
    lobe = lambda i, f: F.col("two")[i][f]
    mean: Column = (lobe(0, "left_ms") + lobe(0, "right_ms") + lobe(1, "left_ms") + lobe(1, "right_ms")) / 4
    gap = F.col("bic1") - F.col("bic2")
    ratio = F.least(lobe(0, "height"), lobe(1, "height")) / F.greatest(lobe(0, "height"), lobe(1, "height"), F.lit(1e-12))
    clear = F.abs(lobe(0, "center_ms") - lobe(1, "center_ms")) / F.greatest(mean, F.lit(1e-6)) * ratio * F.greatest(F.lit(0.0), F.tanh(gap / 25))
    told = fits.withColumn("delta_bic", gap).withColumn("resolvability", clear)
    told = told.withColumn("_ab", F.when(F.col("two").isNotNull(), F.array_sort("two", lambda x, y: F.when(x["center_ms"] < y["center_ms"], -1).when(x["center_ms"] > y["center_ms"], 1).when(x["height"] > y["height"], -1).otherwise(1))))
    first, second = (lambda f: F.col("_ab")[0][f]), (lambda f: F.col("_ab")[1][f])
    tau_a, tau_b = (first("left_ms") + first("right_ms")) / 2, (second("left_ms") + second("right_ms")) / 2
    fits_well = (F.col("delta_bic") >= least_bic) & (F.col("resolvability") >= least_resolved)
    reasons = F.concat_ws(";", F.when(F.col("delta_bic") < least_bic, "criterion"), F.when(F.col("resolvability") < least_resolved, "resolvability"))
    share = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return told.select(
        *fits.columns,
        "delta_bic",
        "resolvability",
        F.log(second("height") / first("height")).alias("log_height_ratio"),
        (second("center_ms") - first("center_ms")).alias("delay_ms"),
        F.log(tau_b / tau_a).alias("log_width_ratio"),
        (first("left_ms") / tau_a).alias("left_a"),
        (first("right_ms") / tau_a).alias("right_a"),
        (second("left_ms") / tau_b).alias("left_b"),
        (second("right_ms") / tau_b).alias("right_b"),
        first("shape").alias("shape_a"),
        second("shape").alias("shape_b"),
        F.coalesce(fits_well, F.lit(False)).alias("resolved"),
        F.when(fits_well, F.sqrt(share(F.col("delta_bic") / 50) * share(F.col("resolvability")))).otherwise(0.0).alias("weight"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("fit_error:"), "error")).when(fits_well, "eligible").otherwise(reasons).alias("reason"),
    )
