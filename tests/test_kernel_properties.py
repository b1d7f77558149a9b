"""Property tests of the numpy GARCH kernel (no Spark)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sigmaflow.operators.garch_kernel import scan, scan_sequential


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 300), block=st.sampled_from([1, 3, 16, 64]), seed=st.integers(0, 10_000),
       student=st.booleans())
def test_blocked_scan_equals_step_by_step(n, block, seed, student):
    rng = np.random.default_rng(seed)
    r = rng.normal(size=n) * rng.uniform(0.001, 2.0)
    g = 7
    alpha = rng.uniform(0.0, 0.3, g)
    beta = rng.uniform(0.0, 0.999, g) * (1 - alpha)
    nu = rng.uniform(2.2, 60.0, g) if student else None
    ll, h, _ = scan(r, alpha, beta, nu, block=block)
    ll2, h2 = scan_sequential(r, alpha, beta, nu)
    assert np.allclose(ll, ll2, rtol=1e-10, atol=1e-9)
    assert np.allclose(h, h2, rtol=1e-10, atol=1e-300)


@settings(max_examples=30, deadline=None)
@given(n=st.integers(2, 200), seed=st.integers(0, 10_000))
def test_per_observation_terms_sum_to_loglik(n, seed):
    rng = np.random.default_rng(seed)
    r = rng.normal(size=n)
    alpha, beta = np.array([0.1, 0.05]), np.array([0.85, 0.9])
    ll, _, terms = scan(r, alpha, beta, None, keep_terms=True)
    assert terms.shape == (n, 2)
    assert np.allclose(terms.sum(axis=0), ll)


def test_refined_fit_beats_dense_brute_force_grid():
    from sigmaflow.operators.garch_kernel import refine
    rng = np.random.default_rng(4)
    n, alpha, beta = 600, 0.12, 0.86
    h, r = 1.0, np.empty(n)
    for t in range(n):
        r[t] = np.sqrt(h) * rng.standard_normal()
        h = alpha * r[t] ** 2 + beta * h
    # brute force: 150 x 150 points over 0 <= alpha <= persistence <= 0.999
    a_axis = np.linspace(0.0, 0.4, 150)
    p_axis = np.linspace(0.5, 0.999, 150)
    A, P = np.meshgrid(a_axis, p_axis)
    keep = A <= P
    a, p = A[keep], P[keep]
    best = -np.inf
    for i in range(0, len(a), 500):
        ll, _, _ = scan(r, a[i:i + 500], p[i:i + 500] - a[i:i + 500], None)
        best = max(best, np.max(ll))
    theta, ll_refined, *_ = refine(r, 0.05, 0.95, None)
    assert ll_refined >= best - 1e-9
    assert abs(theta[0] - alpha) < 0.06 and abs(theta[1] - (alpha + beta)) < 0.03


def test_student_t_likelihood_tends_to_normal():
    rng = np.random.default_rng(8)
    r = rng.normal(size=2000)
    a, b = np.array([0.05]), np.array([0.9])
    ll_n, _, _ = scan(r, a, b, None)
    gaps = [abs(scan(r, a, b, np.array([nu]))[0][0] - ll_n[0]) for nu in (10.0, 100.0, 10_000.0)]
    assert gaps[0] > gaps[1] > gaps[2]
    assert gaps[2] < 1e-2 * abs(ll_n[0]) * 1e-2
