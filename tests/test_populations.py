import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import populations as P
from sigloom.operators import selection as C


def test_tail_probabilities():
    # known quantiles of the distributions
    assert abs(P.normal_tail(1.959963984540054) - 0.05) < 1e-12
    for x, df, p in [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (0.10258658877510107, 2, 0.95)]:
        assert abs(P.chi2_tail(x, df) - p) < 1e-9
    assert P.chi2_tail(0.0, 3) == 1.0


@pytest.mark.parametrize("ranges", [1, 7])
def test_ranks_across_ranges(spark, monkeypatch, ranges):
    """Statistics over many ranges of a value with ties, against all pairs written out."""
    monkeypatch.setattr(P.value_range, "__defaults__", (ranges,))
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 30, 80).astype(float), rng.integers(5, 40, 60).astype(float)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("b", None), ("z", 1.0)], "g string, x double")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert P.mann_whitney(df, "x", "g", ["a", "b"]).first().u == u
    d = P.distances(df, "x", "g", "a", "b").first()
    grid = np.arange(0, 41)
    gap = [abs((a <= v).mean() - (b <= v).mean()) for v in grid]
    assert abs(d.ks - max(gap)) < 1e-12 and abs(d.wasserstein - sum(gap)) < 1e-9
    mean = lambda p, q: np.abs(p[:, None] - q).mean()
    assert abs(d.energy - (2 * mean(a, b) - mean(a, a) - mean(b, b))) < 1e-9


def test_empty_populations(spark):
    df = spark.createDataFrame([], "g string, x double, y double")
    assert P.binned_median(df, "x", "y").collect() == []
    assert P.mann_whitney(df, "x", "g", ["a", "b"]).first().u is None
    assert P.threshold_sweep(df, "x", F.col("g") == "a", [1.0]).first().accepted == 0


def test_a_proposal_inside_a_replaced_interval_goes(spark):
    gone = F.expr("array(struct(10 as start, 20 as end), struct(50 as start, 60 as end))")
    rows = spark.sql("select explode(array(5, 15, 24, 40)) as c, true as ok union all select 24, false")
    got = sorted((r.c, r.ok, r.d.reason, r.d.kept) for r in rows.select("c", "ok", C.boundary_decision(F.col("c"), gone, 5.0, F.col("ok")).alias("d")).collect())
    assert got == [(5, True, "supported", True), (15, True, "inside", False), (24, False, "no_clean_support", False), (24, True, "supported", True), (40, True, "clear", True)]


def test_tests_without_spread_give_nulls(spark):
    make = lambda rows: spark.createDataFrame(rows, "g string, x double")
    tied = make([("a", 1.0), ("a", 1.0), ("b", 1.0)])
    h = P.kruskal(tied, "x", "g", ["a", "b"]).first()
    assert (h.n, h.h, h.df) == (3, None, 1)
    z = P.mann_whitney(tied, "x", "g", ["a", "b"]).first()
    assert (z.u, z.z, z.n_a, z.n_b) == (1.0, None, 2, 1)
    assert P.mann_whitney(make([("a", 1.0)]), "x", "g", ["a", "b"]).first().z is None
    assert P.mann_whitney(make([("a", 1.0), ("b", 2.0)]), "x", "g", ["a", "b"]).first().u == 0.0
    assert P.kruskal(make([("a", 1.0)]), "x", "g", ["a", "b"]).first().h is None
    one = P.distances(make([("a", 1.0), ("a", 2.0)]), "x", "g", "a", "b").first()
    assert (one.ks, one.wasserstein, one.energy) == (None, None, None)
    for rows, df in (([("a", 1.0), ("a", 2.0)], (0, 1)), ([("a", 1.0), ("b", 1.0), ("b", 1.0)], (1, 1)), ([("a", 1.0), ("b", 2.0)], (1, 0)), ([("a", None)], (0, 0))):
        f = P.anova(make(rows), "x", "g").first()
        assert f.f is None and (f.df_between, f.df_within) == df


def test_slowdown_tells_the_readings_apart(spark):
    curves = {
        "uneven": [(0, 0.0), (1, 1.0), (11, 2.0), (12, 3.0)],  # differences are equal, slopes are not: the wide step is slow
        "flat": [(2, 5.0), (3, 5.0), (4, 5.0)],
        "falling": [(7, 5.0), (8, 4.0), (9, 3.0)],
        "straight": [(0, 0.0), (1, 10.0), (2, 20.0), (3, 30.0)],  # no slow step: 95 % of the best
        "two": [(0, 0.0), (1, 1.0)],
        "five": [(0, 0.0), (1, 0.0), (2, 9.0), (3, 9.0), (4, 9.0)],  # smoothed: 0, 3, 6, 9, 9
    }
    df = spark.createDataFrame([(g, float(x), y) for g, c in curves.items() for x, y in c], "g string, x double, y double")
    got = {r.g: r.threshold for r in P.slowdown(df, ["g"], "x", "y").collect()}
    assert got == {"uneven": 11.0, "flat": 2.0, "falling": 7.0, "straight": 3.0, "two": None, "five": 4.0}


def test_an_event_far_beyond_the_span_makes_no_cells(spark):
    spans = spark.createDataFrame([("a", 0, 100), ("b", 0, 5)], "k string, start long, end long")
    events = spark.createDataFrame([("a", 85, 1 << 60), ("a", -(1 << 60), 12), ("b", 0, 1 << 60)], "k string, start long, end long")
    got = sorted((r.k, r.start) for r in C.free_windows(spans, events, "k", 10, 10, 0).collect())
    assert got == [("a", 20), ("a", 30), ("a", 40), ("a", 50), ("a", 60), ("a", 70)]


@pytest.mark.parametrize("n", [1, 2, 11, 3000])
def test_edges_and_medians_gather_no_bin(spark, n):
    """Edges and medians are numpy's; no aggregate holds all values of the column or of a bin."""
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n) * 1e3, rng.integers(0, 50, n).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double").repartition(5)
    edges = P.quantile_edges(df, "x", 10)
    assert np.allclose(edges, np.unique(np.quantile(x, np.arange(11) / 10)), rtol=1e-12, atol=0)
    if n < 11:
        return
    out = P.binned_median(df, "x", "y")
    at = np.minimum(np.searchsorted(edges, x, side="right") - 1, 9)
    want = {k: (int((at == k).sum()), np.median(x[at == k]), np.median(y[at == k])) for k in range(10) if (at == k).sum() >= 3}
    got = {r.bin: (r.n, r.median_x, r.median_y) for r in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan
