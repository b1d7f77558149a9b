"""Numpy kernels for GARCH(1,1) (omega = 0) run inside Spark tasks.

Used through ``mapInPandas``: every input row is one fit sample (a window's
returns as an array), so a task works on whole samples and Spark spreads the
samples over the cluster. All candidates of a grid are scanned together: one
pass over the sample with a vector of candidates per time step.
"""

from __future__ import annotations

import math

import numpy as np

from sigmaflow.config import MAX_PERSISTENCE, NU_BOUNDS

LN_2PI = math.log(2 * math.pi)
#: Steps of the recursion that one matrix product covers.
BLOCK = 32
# Fixed values of the refined search: first spacings of alpha, persistence and nu, how often they are
# halved (the last spacing of alpha is below 1e-5), and the digits at which likelihoods are compared.
FIRST_STEPS = (0.02, 0.02, 2.0)
HALVINGS = 12
COMPARED_DIGITS = 7


def lgamma_vec(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def t_const(nu: np.ndarray) -> np.ndarray:
    nu = np.asarray(nu, dtype=float)
    return lgamma_vec((nu + 1) / 2) - lgamma_vec(nu / 2) - 0.5 * np.log(np.pi * (nu - 2))


def _sequential_sum_sq(r: np.ndarray) -> float:
    total = 0.0
    for x in r:  # same summation order as the SQL scan
        total += x * x
    return total


def scan(r: np.ndarray, alpha: np.ndarray, beta: np.ndarray, nu: np.ndarray | None,
         keep_terms: bool = False, block: int | None = None):
    """Log-likelihood and next-step variance for every candidate (vectors of equal length).

    ``nu`` None means Normal. With ``keep_terms`` the per-observation terms are
    returned as an (n, G) matrix.

    The recursion h_t = alpha r_{t-1}^2 + beta h_{t-1} is linear in h, so a block
    of L steps is one batched matrix product: h[i] = beta^i h_in +
    alpha sum_{j<i} beta^(i-1-j) r2[j]. Only block boundaries are sequential.
    """
    r = np.asarray(r, dtype=float)
    alpha = np.asarray(alpha, dtype=float)
    beta = np.asarray(beta, dtype=float)
    n, g = len(r), len(alpha)
    r2 = r * r
    h_in = np.full(g, _sequential_sum_sq(r) / n if n else np.nan)
    ll = np.zeros(g)
    terms = np.empty((n, g)) if keep_terms else None
    if nu is not None:
        nu = np.asarray(nu, dtype=float)
        c = t_const(nu)[:, None]
        half_nu1 = ((nu + 1) / 2)[:, None]
        nu2 = (nu - 2)[:, None]
    L = max(1, min(BLOCK if block is None else block, n))  # one length, so equal candidates sum alike
    i = np.arange(L)
    expo = i[:, None] - 1 - i[None, :]
    lower = expo >= 0
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        P = np.where(lower[None], beta[:, None, None] ** np.where(lower, expo, 0)[None], 0.0)
        B = beta[:, None] ** i[None, :]
    a = alpha[:, None]
    for start in range(0, n, L):
        blk = r2[start:start + L]
        m = len(blk)
        H = B[:, :m] * h_in[:, None] + a * (P[:, :m, :m] @ blk)
        if nu is None:
            term = -0.5 * (LN_2PI + np.log(H) + blk[None, :] / H)
        else:
            term = c - 0.5 * np.log(H) - half_nu1 * np.log(1 + blk[None, :] / (H * nu2))
        ll += term.sum(axis=1)
        if keep_terms:
            terms[start:start + m] = term.T
        h_in = alpha * blk[-1] + beta * H[:, -1]
    return ll, h_in, terms


def scan_sequential(r: np.ndarray, alpha: np.ndarray, beta: np.ndarray, nu: np.ndarray | None):
    """Step-by-step reference implementation of ``scan`` (for tests)."""
    r = np.asarray(r, dtype=float)
    alpha, beta = np.asarray(alpha, dtype=float), np.asarray(beta, dtype=float)
    h = np.full(len(alpha), _sequential_sum_sq(r) / len(r))
    ll = np.zeros(len(alpha))
    if nu is not None:
        nu = np.asarray(nu, dtype=float)
        c = t_const(nu)
    for x in r:
        x2 = x * x
        if nu is None:
            ll += -0.5 * (LN_2PI + np.log(h) + x2 / h)
        else:
            ll += c - 0.5 * np.log(h) - (nu + 1) / 2 * np.log(1 + x2 / (h * (nu - 2)))
        h = alpha * x2 + beta * h
    return ll, h


def grid_scan(r: np.ndarray, grid: dict[str, np.ndarray]):
    """Scan one sample against a grid dict with alpha, beta, nu (nan for Normal)."""
    nu = grid["nu"]
    is_t = ~np.isnan(nu)
    ll = np.empty(len(nu))
    h = np.empty(len(nu))
    with np.errstate(all="ignore"):  # a candidate whose variance falls to 0 has no likelihood
        if (~is_t).any():
            ll[~is_t], h[~is_t], _ = scan(r, grid["alpha"][~is_t], grid["beta"][~is_t], None)
        if is_t.any():
            ll[is_t], h[is_t], _ = scan(r, grid["alpha"][is_t], grid["beta"][is_t], nu[is_t])
    return ll, h


# ---------------------------------------------------------------- refinement


def _clip(theta: np.ndarray, student: bool) -> np.ndarray:
    a = np.clip(theta[:, 0], 0.0, MAX_PERSISTENCE)
    p = np.clip(theta[:, 1], 0.0, MAX_PERSISTENCE)
    a = np.minimum(a, p)
    out = [a, p]
    if student:
        out.append(np.clip(theta[:, 2], *NU_BOUNDS))
    return np.stack(out, axis=1)


def best_index(ll: np.ndarray, alpha, persistence, nu) -> int:
    """Arg-max of the likelihood at the compared digits; ties to the smallest (alpha, persistence, nu)."""
    key = np.where(np.isfinite(ll), np.round(ll, COMPARED_DIGITS), -np.inf)
    return int(np.lexsort((-np.nan_to_num(nu), -np.asarray(persistence), -np.asarray(alpha), key))[-1])


def refine(r: np.ndarray, alpha0: float, persistence0: float, nu0: float | None):
    """Bounded grid search around the best point with shrinking spacing, in (alpha, persistence[, nu]):
    no derivatives, so a check of ``garch_newton.maximise``, which the fit jobs use.

    Each round evaluates the current point and all its neighbours at the present spacing in
    one vectorised scan. A better neighbour becomes the point, otherwise the spacing is halved; after
    ``HALVINGS`` halvings the fit has converged. Every move raises the likelihood by a unit of the compared
    digits or more, so the search ends by itself. Returns theta, loglik, h_next, rounds, converged.
    """
    student = nu0 is not None
    cur = np.array([alpha0, persistence0] + ([nu0] if student else []), dtype=float)
    if not len(r) or not np.isfinite(r).all():
        return np.full(len(cur), np.nan), np.nan, np.nan, 0, False
    first = np.array(FIRST_STEPS[: len(cur)])
    offsets = np.stack(np.meshgrid(*[[-1, 0, 1]] * len(cur), indexing="ij"), axis=-1).reshape(-1, len(cur))

    def evaluate(thetas):
        thetas = _clip(thetas, student)
        ll, h, _ = scan(r, thetas[:, 0], thetas[:, 1] - thetas[:, 0], thetas[:, 2] if student else None)
        return thetas, ll, h

    cur, ll, h = (x[0] for x in evaluate(cur[None, :]))
    rounds = halved = 0
    while halved < HALVINGS and np.isfinite(ll):
        rounds += 1
        thetas, lls, hs = evaluate(cur[None, :] + offsets * (first / 2**halved)[None, :])
        i = best_index(lls, thetas[:, 0], thetas[:, 1], thetas[:, 2] if student else np.zeros(len(lls)))
        if np.round(lls[i], COMPARED_DIGITS) > np.round(ll, COMPARED_DIGITS):
            cur, ll, h = thetas[i], lls[i], hs[i]
        else:
            halved += 1
    return cur, ll, h, rounds, bool(np.isfinite(ll))
