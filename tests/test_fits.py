"""Bounded fits: planted lobes found again, the stack beside a solver of one trace, bounds, and rows without a fit."""

import numpy as np
from pyspark.sql import functions as F

from sigloom.operators import fits as L


def lobe(t, a, mid, left, right, s):
    return np.array([np.exp(a - 0.5 * (abs(x - mid) / np.exp(left if x < mid else right)) ** s) for x in t])


def slow_solver(f, x, low, high):
    """One problem, derivatives by differences, damped normal equations, bounds by projection."""
    damp, cost = 1e-2, (f(x) ** 2).sum()
    for _ in range(3000):
        r = f(x)
        jac = np.stack([(f(x + h) - f(x - h)) / 2e-6 for h in np.eye(len(x)) * 1e-6], 1)
        g = jac.T @ r
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        step = np.zeros(len(x))
        m = (jac.T @ jac)[np.ix_(free, free)]
        step[free] = -np.linalg.solve(m + damp * np.diag(np.diag(m)), g[free])
        new = np.clip(x + step, low, high)
        c = (f(new) ** 2).sum()
        if c <= cost:
            done = abs(new - x).max() < 1e-12
            x, cost, damp = new, c, max(damp / 4, 1e-9)
            if done:
                break
        else:
            damp *= 3
            if damp > 1e9:
                break
    return x


def test_derivatives_are_those_of_differences():
    rng = np.random.default_rng(0)
    t = np.tile(np.linspace(0, 2, 40), (3, 1)) + rng.normal(size=(3, 1)) * 1e-3
    x = np.tile([0.1, 0.7, -1.0, -1.4, 2.2, -0.3, 1.3, -1.2, -0.9, 1.7], (3, 1)) + rng.normal(size=(3, 10)) * 0.05
    value, jac = L.lobes(t, x)
    assert np.allclose(value[1], lobe(t[1], *x[1, :5]) + lobe(t[1], *x[1, 5:]), atol=1e-14)
    for j in range(10):
        h = np.zeros(10)
        h[j] = 1e-6
        assert np.allclose(jac[:, :, j], (L.lobes(t, x + h)[0] - L.lobes(t, x - h)[0]) / 2e-6, atol=1e-7)


def test_stack_equals_a_solver_of_one_problem_and_finds_what_was_planted():
    rng = np.random.default_rng(1)
    t = np.linspace(0, 2, 60)
    true = np.stack([[rng.uniform(-0.5, 0.5), rng.uniform(0.8, 1.2), np.log(rng.uniform(0.1, 0.3)), np.log(rng.uniform(0.1, 0.3)), rng.uniform(1.5, 3)] for _ in range(12)])
    clean = np.stack([lobe(t, *x) for x in true])
    noisy = clean + rng.normal(size=clean.shape) * 0.02
    low, high = np.tile([-3, 0.0, np.log(0.02), np.log(0.02), 1.0], (12, 1)), np.tile([3, 2.0, np.log(0.8), np.log(0.8), 4.0], (12, 1))
    low[0, 1] = true[0, 1] + 0.05  # an optimum on the bound
    start = np.tile([0.0, 1.0, np.log(0.2), np.log(0.2), 2.0], (12, 1))
    for data, exact in ((clean, True), (noisy, False)):
        x, cost = L.bounded_least_squares(lambda p, w: (lambda v, j: (v - data[w], j))(*L.lobes(np.tile(t, (len(w), 1)), p)), start, low, high)
        assert (x >= low).all() and (x <= high).all()
        if exact:
            assert np.abs(x[1:] - true[1:]).max() < 1e-6
        assert x[0, 1] == low[0, 1]
        for i in range(12):
            one = slow_solver(lambda p: lobe(t, *p) - data[i], np.clip(start[i], low[i], high[i]), low[i], high[i])
            assert np.abs(one - x[i]).max() < 1e-6


def test_soft_loss_withstands_outliers():
    t = np.linspace(0, 2, 80)[None]
    true = np.array([[0.2, 0.9, -1.5, -1.5, 2.0]])
    data = L.lobes(t, true)[0]
    data[0, ::9] += 1.0
    fit = lambda soft: L.bounded_least_squares(lambda p, w: (lambda v, j: (v - data, j))(*L.lobes(t, p)), np.array([[0.0, 1.0, -1.2, -1.2, 2.0]]), np.full((1, 5), -5.0), np.full((1, 5), 5.0), soft)[0]
    assert np.abs(fit(0.01) - true).max() < 0.05 < np.abs(fit(None) - true).max()


def trace(*bursts, n=4096, seed=0):
    i = np.arange(n)
    x = 0.002 * np.random.default_rng(seed).normal(size=n)
    for amp, mid, width in bursts:
        x = x + amp * np.exp(-0.5 * ((i - mid) / width) ** 2) * np.cos(2 * np.pi * 0.02 * (i - mid))
    return [float(v) for v in x]


def test_criteria_tell_one_lobe_from_two_and_every_row_is_answered(spark):
    rows = [("one", trace((1.0, 2000, 150)), 1500.0, 2500.0), ("two", trace((1.0, 1700, 120), (0.6, 2500, 120)), 1300.0, 2900.0)]
    rows += [("null", None, 1.0, 2.0), ("empty", [], 1.0, 2.0), ("nan", [float("nan")] * 4096, 1.0, 4000.0), ("hole", [1.0, None], 1.0, 2.0), ("short", [1.0, 2.0], 0.0, 2.0), ("open", trace((1.0, 2000, 150)), None, 2500.0), ("flat", [0.0] * 4096, 1000.0, 2000.0), ("outside", trace((1.0, 2000, 150)), 9000.0, 9100.0)]
    df = spark.createDataFrame(rows, "k string, x array<double>, a double, b double")
    got = {r.k: r for r in L.compared(L.envelope_fits(df, "k", "x", "a", "b")).collect()}
    assert len(got) == len(rows)
    two = got["two"]
    assert two.resolved and two.reason == "eligible" and two.weight > 0.9
    assert abs(two.delay_ms - 0.4) < 0.02 and abs(two.log_height_ratio - np.log(0.6)) < 0.1
    one = got["one"].one
    assert abs(one.center_ms - 1.0) < 0.01 and abs(one.left_ms - 0.075) < 0.01 and abs(one.shape - 2) < 0.3 and got["one"].residual1 < 0.05
    assert got["one"].delta_bic < two.delta_bic
    assert {k: got[k].error for k in ("null", "empty", "nan", "hole", "short", "open", "flat", "outside")} == {"null": "signal", "empty": "signal", "nan": "signal", "hole": "signal", "short": "support", "open": "support", "flat": "flat", "outside": "support"}
    assert got["flat"].one is None and not got["flat"].resolved and got["flat"].weight == 0 and got["flat"].reason == "fit_error:flat"
    assert L.envelope_fits(df.where(F.lit(False)), "k", "x", "a", "b").collect() == []


def test_fits_sum_by_products_and_keep_the_derivatives_of_a_model():
    """Normal equations go through matrix products, many times faster than sums of three arrays by index; what a model hands out is not written to."""
    rng = np.random.default_rng(2)
    jac, y = rng.normal(size=(3, 40, 4)), rng.normal(size=(3, 40))
    kept = jac.copy()
    low, high = np.full((3, 4), -10.0), np.full((3, 4), 10.0)
    x, _ = L.bounded_least_squares(lambda p, w: (np.einsum("bnp,bp->bn", jac[w], p) - y[w], jac if len(w) == 3 else jac[w]), np.zeros((3, 4)), low, high)
    assert np.array_equal(jac, kept)
    assert np.allclose(x, [np.linalg.lstsq(j, v, rcond=None)[0] for j, v in zip(jac, y)], atol=1e-8)
    called, einsum = [], np.einsum
    t = np.tile(np.linspace(0, 2, 128), (2, 1))
    e = np.stack([lobe(t[0], 0.0, 0.9 + 0.1 * i, -1.5, -1.6, 2.0) for i in range(2)])
    np.einsum = lambda rule, *a, **k: (called.append(rule), einsum(rule, *a, **k))[1]
    try:
        assert all(abs(f["one"]["center_ms"] - 0.9 - 0.1 * i) < 1e-3 for i, f in enumerate(L.fit_stack(t, e)))
    finally:
        np.einsum = einsum
    assert not [r for r in called if "n" in r]  # no sum over the points


def test_lobes_at_their_centre_have_no_pull():
    """A point at a centre takes the place of a logarithm of zero, beside points elsewhere."""
    t, x = np.array([[0.0, 0.5, 1.0]]), np.array([[0.0, 0.5, -1.0, -1.0, 2.0]])
    value, jac = L.lobes(t, x)
    assert value[0, 1] == 1 and jac[0, 1].tolist() == [1, 0, 0, 0, 0] and np.isfinite(jac).all()
    assert L.lobes(np.array([[0.0, 0.5]]), x)[1].tolist() == jac[:, :2].tolist()
