"""Exact derivatives, bounded Newton search, sandwich errors and warm-started rolling fits."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaflow.config import MAX_PERSISTENCE, Params
from sigmaflow.operators import garch as G
from sigmaflow.operators import garch_newton as N
from sigmaflow.operators.garch_kernel import refine, scan


def simulate(alpha, beta, n, seed, nu=None):
    rng = np.random.default_rng(seed)
    h, r = 1.0, np.empty(n)
    for t in range(n):
        z = rng.standard_normal() if nu is None else rng.standard_t(nu) / math.sqrt(nu / (nu - 2))
        r[t] = math.sqrt(h) * z
        h = alpha * r[t] ** 2 + beta * h
    return r


def test_polygamma_by_recurrence_and_known_values():
    assert math.isclose(N.digamma(1.0), -0.5772156649015329, rel_tol=1e-14)
    assert math.isclose(N.trigamma(1.0), math.pi**2 / 6, rel_tol=1e-14)
    for x in (0.3, 1.05, 2.5, 50.5):
        assert math.isclose(N.digamma(x + 1), N.digamma(x) + 1 / x, rel_tol=1e-12, abs_tol=1e-13)
        assert math.isclose(N.trigamma(x + 1), N.trigamma(x) - 1 / x**2, rel_tol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 700])
def test_recursion_is_the_plain_loop(n):
    x = np.random.default_rng(n).normal(size=n)
    for beta in (0.0, 0.4, 0.999):
        y, want = 0.7, [0.7]
        for v in x:
            y = v + beta * y
            want.append(y)
        assert np.allclose(N.recursion(x, beta, 0.7), want, rtol=1e-13, atol=1e-13)


def plain_derivatives(r, alpha, beta, nu):
    """Scores and Hessian by the step-by-step chain rule in 50-digit arithmetic."""
    from decimal import Decimal, getcontext
    getcontext().prec = 50
    d = Decimal
    x = [d(float(v)) ** 2 for v in r]
    a, b = d(alpha), d(beta)
    h, ha, hb, hab, hbb = sum(x) / len(x), d(0), d(0), d(0), d(0)
    g, hess = [d(0)] * 3, [[d(0)] * 3 for _ in range(3)]
    prod = [[d(0)] * 3 for _ in range(3)]
    for v in x:
        y, da, db = v / h, ha / h, hb / h
        if nu is None:
            s1, s2, sn, snn, shn = (y - 1) / 2, d("0.5") - y, d(0), d(0), d(0)
        else:
            n = d(nu)
            k, half = n - 2, (n + 1) / 2
            t = k + y
            c1 = d(0.5 * N.digamma((nu + 1) / 2) - 0.5 * N.digamma(nu / 2)) - d("0.5") / k
            c2 = d(0.25 * N.trigamma((nu + 1) / 2) - 0.25 * N.trigamma(nu / 2)) + d("0.5") / k**2
            s1, s2 = half * y / t - d("0.5"), d("0.5") - half * y * (2 * k + y) / t**2
            sn, snn = c1 - (1 + y / k).ln() / 2 + half * y / (k * t), c2 + y / (k * t) - half * y * (2 * k + y) / (k * t) ** 2
            shn = y / t / 2 - half * y / t**2
        score = [s1 * da, s1 * db, sn]
        second = [[s2 * da * da, s2 * da * db + s1 * hab / h, shn * da], [None, s2 * db * db + s1 * hbb / h, shn * db], [None, None, snn]]
        for i in range(3):
            g[i] += score[i]
            for j in range(i, 3):
                hess[i][j] += second[i][j]
                prod[i][j] += score[i] * score[j]
        h, ha, hb, hab, hbb = a * v + b * h, v + b * ha, h + b * hb, ha + b * hab, 2 * hb + b * hbb
    size = 2 if nu is None else 3
    full = lambda m: np.array([[float(m[min(i, j)][max(i, j)]) for j in range(size)] for i in range(size)])
    return np.array([float(v) for v in g[:size]]), full(hess), full(prod)


@pytest.mark.parametrize("nu", [None, 4.5])
def test_derivatives_and_errors_in_high_precision(nu):
    r = simulate(0.09, 0.89, 300, 4, nu)
    alpha, beta = 0.12, 0.8
    g, hess, prod = plain_derivatives(r, alpha, beta, nu)
    ll, h_next, scores, mine = N.derivatives(r * r, alpha, beta, nu, N.mean_square(r))
    want_ll, want_h, _ = scan(r, np.array([alpha]), np.array([beta]), None if nu is None else np.array([nu]))
    assert math.isclose(ll, want_ll[0], rel_tol=1e-12) and math.isclose(h_next, want_h[0], rel_tol=1e-12)
    assert np.allclose(scores.sum(axis=0), g, rtol=1e-10, atol=1e-9) and np.allclose(mine, hess, rtol=1e-10)
    inverse = np.linalg.inv(hess)
    se, at_bound = N.sandwich_se(r, np.array([alpha, alpha + beta] + ([] if nu is None else [nu])))
    assert np.allclose(se, np.sqrt(np.diag(inverse @ prod @ inverse)), rtol=1e-8) and not at_bound


def test_tiny_variances_do_not_overflow():
    r = simulate(0.05, 0.949, 60_000, 2)  # without a constant the variance falls towards 0
    theta, ll, h_next, _, converged = N.maximise(r, 0.05, 0.99, None)
    assert converged and np.isfinite(ll) and h_next < 1e-30 and abs(theta[0] - 0.05) < 0.01


@pytest.mark.parametrize(("n", "seed", "nu"), [(4000, 5, None), (3000, 9, 5.0), (3000, 9, None), (12, 3, None), (400, 8, 3.0)])
def test_same_top_as_the_plain_search(n, seed, nu):
    r = simulate(0.09, 0.9, n, seed, nu)
    start = (0.05, 0.98, None if nu is None else 6.0)
    theta, ll, h_next, steps, converged = N.maximise(r, *start)
    plain, plain_ll, plain_h, *_ = refine(r, *start)
    assert converged and steps < 40
    assert ll >= plain_ll - 1e-7 and abs(ll - plain_ll) < 1e-5
    assert np.allclose(theta[:2], plain[:2], atol=1e-4) and math.isclose(h_next, plain_h, rel_tol=1e-3)
    _, _, scores, _ = N.derivatives(r * r, theta[0], theta[1] - theta[0], None if nu is None else theta[2], N.mean_square(r))
    if 0 < theta[0] and theta[1] < MAX_PERSISTENCE:
        assert np.abs(scores.sum(axis=0)[:2]).max() < 1e-6 * max(1, abs(ll))


def test_search_ends_on_flat_likelihoods_and_refuses_nulls():
    theta, ll, _, _, converged = N.maximise(np.array([1.0, -1.0] * 200), 0.05, 0.99, 4.0)
    assert converged and np.isfinite(ll) and theta[2] == 100.0
    assert not N.maximise(np.array([0.1, np.nan]), 0.05, 0.99, None)[4] and not N.maximise(np.array([]), 0.05, 0.99, 4.0)[4]


def test_constant_zero_returns_have_no_fit():
    assert not N.maximise(np.zeros(20), 0.05, 0.99, None)[4]


@pytest.fixture(scope="module")
def rolling(spark):
    from sigmaflow.plans.garch_jobs import FitInputs
    r = simulate(0.06, 0.93, 60 * 48, 21, 6.0)
    rows = [("s", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=30 * i), float(x)) for i, x in enumerate(r)]
    rets = (spark.createDataFrame(rows, "series string, date timestamp_ntz, return double").withColumn("day", F.to_date("date").cast("timestamp_ntz")))
    return FitInputs(rets, Params(start=dt.datetime(2020, 1, 1), end=dt.datetime(2020, 3, 1), forecast_start=dt.datetime(2020, 1, 30, 23, 55), excluded_day=None))


def test_warm_starts_reach_the_tops_of_cold_ones_in_fewer_steps(rolling):
    keys = ["series", "window_id"]
    cold = G.mle_fit_numpy(rolling.samples(rolling.windows), keys, with_se=False).toPandas()
    warm = G.mle_fit_numpy(rolling.blocks(rolling.windows, 16), keys, with_se=False).toPandas()
    assert not cold.warm.any() and warm.warm.sum() == len(warm) - 2 * 2  # two blocks, two distributions
    m = cold.merge(warm, on=[*keys, "distribution"])
    assert len(m) == len(cold) == 60 and m.converged_x.all() and m.converged_y.all()
    for c in ("loglik", "alpha", "persistence", "h_next"):
        assert np.allclose(m[f"{c}_x"], m[f"{c}_y"], rtol=1e-8, atol=1e-9), c
    inner = m[m.warm_y]
    assert inner.rounds_y.sum() < inner.rounds_x.sum()


def test_short_samples_end_on_the_best_of_several_tops(spark):
    rng = np.random.default_rng(0)
    samples = [("s", i, (rng.standard_t(3, size=20) * 0.5).tolist()) for i in range(30)]
    df = spark.createDataFrame(samples, "series string, window_id long, r array<double>")
    fits = {(f.window_id, f.distribution): f for f in G.mle_fit_numpy(df, ["series", "window_id"], with_se=False).collect()}
    for _, i, r in samples:
        tops = [N.maximise(np.array(r), a, p, None)[1] for a in (0.0, 0.1, 0.3, 0.6, 0.9) for p in (0.91, 0.999)]
        assert fits[i, "Normal"].loglik >= max(tops) - 0.05
        assert fits[i, "Normal"].loglik >= refine(np.array(r), 0.05, 0.98, None)[1] - 1e-6
