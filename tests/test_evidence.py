"""Evidence of events against direct sums and planted traces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import evidence as E

FS, N = 2e6, 8192
RNG = np.random.default_rng(11)
T = np.arange(N) / FS


def burst(frequency, middle=4096, width=600.0, phase=0.0):
    return np.exp(-0.5 * ((np.arange(N) - middle) / width) ** 2) * np.sin(2 * np.pi * frequency * T + phase)


def frame(spark, traces, spans=None):
    spans = spans or [[] for _ in traces]
    rows = [(i, None if x is None else [float(v) for v in x], s) for i, (x, s) in enumerate(zip(traces, spans))]
    return spark.createDataFrame(rows, "key int, signal array<double>, spans array<struct<start:int,end:int>>")


def test_transforms_are_the_direct_sums():
    for n in (24, 101, 256):
        x = RNG.normal(size=(3, n)) + 5
        share, ratio = E.isolation(x)
        period = E.periodicity(x)
        for i in range(3):
            d = (x[i] - x[i].mean()) * np.hanning(n)
            k = np.arange(n // 2 + 1)
            p = np.abs((d[None, :] * np.exp(-2j * np.pi * np.outer(k, np.arange(n)) / n)).sum(1)) ** 2
            top = p.argmax()
            beside = [p[j] for j in k if max(3, len(p) / 8) <= abs(j - top) <= len(p) / 4]
            assert abs(share[i] - p[top] / p.sum()) < 1e-10 and abs(ratio[i] / (p[top] / np.mean(beside)) - 1) < 1e-8
            d = x[i] - x[i].mean()
            direct = [abs(sum(d[j] * d[j + lag] for j in range(n - lag))) / (d @ d) for lag in range(max(2, n // 20), n)]
            assert abs(period[i] - max(direct)) < 1e-10
    silent = np.zeros((2, 64))
    assert E.isolation(silent)[0].tolist() == [1, 1] and E.periodicity(silent).tolist() == [1, 1] and np.isnan(E.isolation(silent)[1]).all()
    assert E.isolation(np.ones((1, 15)))[0].tolist() == [1] and E.periodicity(np.ones((1, 23))).tolist() == [1]


def test_tones_chirps_and_noise(spark):
    tone, noise = np.sin(2 * np.pi * 40e3 * T), [RNG.normal(size=N) for _ in range(20)]
    chirp = np.sin(2 * np.pi * (30e3 * T + 0.5 * 60e3 / T[-1] * T * T))
    df = frame(spark, [tone, chirp, *noise, None, [], np.full(N, np.nan)], [[(100, 1200), (0, 999)], [(0, N)], *[[(0, 2048), (50, 700)]] * 20, [(0, 9)], [(0, 9)], [(0, 9)]])
    got = E.spectral_evidence(df, "key", "signal").collect()
    assert {r.kind for r in got if r.key == 0} == {"tone"} and {r.kind for r in got if r.key == 1} == {"chirp"}
    assert {r.kind for r in got if r.key > 1} == {"noise_like"} and len(got) == 43


def test_spans_are_clamped_and_bad_ones_left_out(spark):
    df = frame(spark, [np.sin(T * 3e5)], [[(-50, 100), None, (N - 10, N + 90), (N + 1, N + 9), (7, 7), (None, 9)]]).withColumn("span", F.lit("clash"))
    assert [(r.span, r.start, r.end) for r in E.spectral_evidence(df, "key", "signal").collect()] == [(0, 0, 100), (2, N - 10, N)]
    assert E.spectral_evidence(df.limit(0), "key", "signal").collect() == []
    made = E.spans_of(spark.createDataFrame([(1, 5, 9), (1, 2, 4), (None, 1, 2)], "key int, start int, end int"), "key").collect()
    assert len(made) == 1 and [tuple(s) for s in made[0].spans] == [(2, 4), (5, 9)]


def slow_outward(z, start, end, level, most):
    a, b = start, end
    while a > max(0, start - most) and z[a - 1] >= level:
        a -= 1
    while b < min(len(z), end + most) and z[b] >= level:
        b += 1
    return a, b


def test_edges_move_outward_only_and_within_the_bound():
    for _ in range(300):
        z = RNG.normal(size=60).cumsum()
        a, b = sorted(RNG.integers(0, 61, 2).tolist())
        most = int(RNG.integers(0, 25))
        assert E.outward(z, a, b, 0.0, most) == slow_outward(z, a, b, 0.0, most)


def test_extension_on_both_sides(spark):
    x = burst(40e3) + 0.001 * RNG.normal(size=N)
    got = E.extended_spans(frame(spark, [x], [[(3900, 4300), (3000, 3010), (500, 600)]]), "key", "signal", most_ms=0.4).collect()
    core, tail, quiet = got
    assert core.new_start == 3900 - 800 and core.new_end == 4300 + 800 and core.grown  # to the bound on both sides
    wide = E.extended_spans(frame(spark, [x], [[(3900, 4300)]]), "key", "signal", most_ms=4.0).first()
    assert 1000 < wide.new_start < 3100 and 5100 < wide.new_end < 7200  # to the burst's own edges
    assert abs((wide.new_start + wide.new_end) / 2 - 4096) < 150
    assert tail.new_start >= 3000 - 800 and tail.new_end <= 3010 + 800 and (quiet.new_start, quiet.new_end, quiet.grown) == (500, 600, False)


def test_regions_hold_their_candidates(spark):
    rows = [(50, 40, 60, 0, 100), (150, 40, 160, 0, 100), (100, 90, 130, 0, 100), (100, 100, 130, 0, 100)]
    df = spark.createDataFrame(rows, "c int, s int, e int, rs int, re int")
    assert [r[0] for r in df.select(E.in_region(*map(F.col, ("c", "s", "e", "rs", "re")))).collect()] == [True, False, True, False]


def test_coherence_of_known_phases():
    steady = np.exp(1j * (0.7 * np.arange(9) + np.array([[0.1], [0.4]])))
    assert np.allclose(E.coherence(steady), (1, 1))
    drifting = np.stack([np.exp(0.7j * np.arange(8)), np.exp(1j * (0.7 + np.pi / 4) * np.arange(8))])
    assert np.allclose(E.coherence(drifting), (1, 0))  # steady in time each, no fixed phase between them
    assert E.coherence(steady[:, :1]) == (None, None) and E.coherence(steady[:1])[1] is None and E.coherence(np.empty((0, 5))) == (None, None)


def test_two_tones_are_strict_and_noise_is_rejected(spark):
    faint = lambda: 0.01 * RNG.normal(size=N)
    tones = [burst(31250.0, 3000 + 200 * i, 300.0) + burst(62500.0, 3000 + 200 * i, 300.0) + faint() for i in range(6)]
    noise = [RNG.normal(size=N) for _ in range(20)]
    got = E.coherent_events(frame(spark, [*tones, *noise, None, np.zeros(N), np.zeros(64)]), "key", "signal").collect()
    strict = [r for r in got if r.quality == "strict"]
    assert {r.key for r in strict} == set(range(6)) and len(strict) == 6
    for r in strict:
        assert r.peaks == 2 and abs(r.low_peak - 31250) < 4000 and abs(r.high_peak - 62500) < 4000 and r.between is not None and r.coherence > 0.5 and abs(r.center - (3000 + 200 * r.key)) < 150
    assert all(r.quality == "reject" for r in got if r.key >= 6)


@pytest.mark.parametrize("share, limit", [(0.99, 5), (0.5, 2)])
def test_count_guard(spark, share, limit):
    past = spark.createDataFrame([("a", u, i) for u, n in enumerate([1, 2, 2, 3, 5]) for i in range(n)], "g string, u int, i int")
    now = spark.createDataFrame([("a", 0, i) for i in range(6)] + [("a", 1, i) for i in range(5)] + [("b", 2, i) for i in range(3)] + [(None, 3, 1)], "g string, u int, i int")
    got = {(r.g, r.u): (r.n, r.limit, r.suspect) for r in E.count_guard(now, past, "g", "u", share=share).collect()}
    assert got == {("a", 0): (6, limit, True), ("a", 1): (5, limit, 5 > limit), ("b", 2): (3, 2, True)}
