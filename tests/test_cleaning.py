import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import dsp
from sigloom.operators import cleaning as L
from sigloom.operators import detectors as D

REGIONS = "k int, outer_start int, outer_end int, core_start int, core_end int, carrier array<double>"


def band(x, c=D.Detection()):
    return dsp.zero_phase(dsp.butter_bandpass(c.low, c.high, c.order, c.fs), x[None])[0]


def test_repairs_in_either_domain(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(3000)
    carrier = rng.standard_normal(400)
    traces = spark.createDataFrame([(1, x.tolist()), (2, x.tolist()), (3, None)], "k int, x array<double>")
    regions = spark.createDataFrame([(1, 1000, 1400, 1100, 1300, carrier.tolist())], REGIONS)
    for domain in ("signal", "filtered"):
        got = {r.k: r for r in L.repaired(traces, regions, "k", "x", domain=domain).collect()}
        assert sorted(got) == [1, 2] and got[1].problem is None and (got[1].regions, got[2].regions) == (1, 0)
        clean = np.array(got[1].clean)
        assert (clean[:1000] == x[:1000]).all() and (clean[1400:] == x[1400:]).all() and (clean[1100:1300] == carrier[100:300]).all()
        assert got[2].clean == x.tolist() and np.allclose(got[2].filtered, band(x))
        through = np.array(got[1].filtered)
        if domain == "signal":
            assert np.allclose(through, band(clean))
        else:  # nothing beyond the region changes
            assert np.allclose(through[:1000], band(x)[:1000]) and np.allclose(through[1100:1300], band(carrier)[100:300])
    with pytest.raises(ValueError):
        L.repaired(traces, regions, "k", "x", domain="other")


def test_unfit_regions_are_named_and_change_nothing(spark):
    x = [float(i % 7) for i in range(2000)]
    traces = spark.createDataFrame([(i, x) for i in range(4)], "k int, x array<double>")
    c = [0.0] * 100
    rows = [(0, 100, 200, 120, 180, c), (0, 150, 250, 170, 200, c), (1, 1950, 2050, 1960, 1990, c), (2, 100, 200, 120, 180, c[:50])]
    got = {r.k: r for r in L.repaired(traces, spark.createDataFrame(rows, REGIONS), "k", "x").collect()}
    assert [got[i].problem for i in range(4)] == ["overlap", "outside", "carrier", None]
    assert all(got[i].clean == x for i in range(4))


def test_the_response_radius_holds_its_share():
    c = D.Detection()
    n = 4096
    pulse = np.zeros(n)
    pulse[n // 2] = 1
    size = np.abs(band(pulse, c))
    r = L.response_radius(c, n, 0.9)
    held = lambda r: size[n // 2 - r : n // 2 + r + 1].sum() / size.sum()
    assert held(r) >= 0.9 > held(r - 1)
    assert L.response_radius(c, n, 0.99) > r


def test_policies(spark):
    spans = spark.createDataFrame([("a", 4, 6), ("a", 1, 2)], "k string, start int, end int")
    assert [(r.nth, r.start, r.length, r.action) for r in sorted(L.actions(spans, "k", "keep").collect())] == [(0, 1, 1, "reported"), (1, 4, 2, "reported")]
    with pytest.raises(ValueError):
        L.actions(spans, "k", "burn")
    traces = spark.createDataFrame([("a", [float(i) for i in range(8)]), ("b", [1.0])], "k string, x array<double>")
    pool = spark.createDataFrame([(0, [-1.0, -1.0, -1.0])], "number int, noise array<double>")
    got = {r.k: r.clean for r in L.replaced(traces, L.with_carriers(spans, pool, "k", "s", 1), "k", "x").collect()}
    assert got == {"a": [0, -1, 2, 3, -1, -1, 6, 7], "b": [1]}
    none = traces.withColumn("s", F.lit(None).cast("array<struct<start:int,end:int>>")).select(L.masked(F.col("x"), F.col("s")).alias("y"))
    assert sorted(none.collect())[0].y == [0, 1, 2, 3, 4, 5, 6, 7]


def test_two_bursts_in_one_candidate_are_split(spark):
    n = np.arange(16384)
    burst = lambda at, a: a * np.exp(-(((n - at) / 260.0) ** 2)) * np.sin(2 * np.pi * 30e3 * n / 2e6)
    x = burst(6000, 1.0) + burst(7300, 0.8) + 1e-3 * np.random.default_rng(1).standard_normal(len(n))
    df = spark.createDataFrame([(1, x.tolist())], "k int, x array<double>")
    whole = D.detect_events(df, "k", "x", D.Detection(max_ms=5.0)).collect()
    got = sorted((r.part, r.parts, r.center) for r in D.deblended_events(df, "k", "x").collect())
    assert len(whole) == 1 and [g[:2] for g in got] == [(0, 2), (1, 2)]
    assert abs(got[0][2] - 6000) < 200 and abs(got[1][2] - 7300) < 200


def test_valleys():
    assert D.valleys(np.array([0.0, 5, 1, 6, 0]), 3, 0.5, 1).tolist() == [2]
    assert D.valleys(np.array([0.0, 5, 4, 6, 0]), 3, 0.5, 1).tolist() == []
    assert D.valleys(np.array([]), 3, 0.5, 1).tolist() == []
