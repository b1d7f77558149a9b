"""Likelihood of GARCH(1,1) with exact derivatives, and its bounded maximum by Newton steps.

With x = r^2, the variance and its derivatives by alpha and beta are five linear recursions with one coefficient:

    h   = alpha x + beta h        ha  = x + beta ha        hb  = h + beta hb
    hab = ha + beta hab           hbb = 2 hb + beta hbb    (all on the right one step back; haa = 0)

each starting at 0 but h, which starts at mean(x). A recursion is run in blocks of ``BLOCK`` steps: all blocks at once
by one product with a triangular matrix of powers of beta, then the blocks' ends one after another.
The chain rule turns them into the likelihood's gradient and Hessian.

The search runs over (alpha, persistence[, 1/nu]), where the bounds are a box and alpha <= persistence. A coordinate at a bound
that the gradient pushes against is held; the others take a Newton step (curvatures of the wrong sign are turned over, so that every step
climbs), halved until the likelihood rises. It ends when the step no longer moves the point.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from sigmaflow.config import MAX_PERSISTENCE, NU_BOUNDS

LN_2PI = math.log(2 * math.pi)
BLOCK = 128
# Fixed values of the search: most steps, longest step of each coordinate, the relative move that counts as none.
MOST_STEPS = 200
LONGEST = (0.1, 0.1, 0.1)
NO_MOVE = 1e-11
HALVINGS = 40


def digamma(x: float) -> float:
    """Derivative of ln Gamma for x > 0."""
    total = 0.0
    while x < 12:
        total -= 1 / x
        x += 1
    y = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    """Second derivative of ln Gamma for x > 0."""
    total = 0.0
    while x < 12:
        total += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return total + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


@lru_cache(maxsize=64)
def _powers(beta: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Triangle of beta^(i-1-j) for j < i (rows 0..size), and beta^0..beta^size."""
    i = np.arange(size + 1)
    with np.errstate(under="ignore"):
        power = beta ** i if beta else np.append(1.0, np.zeros(size))
    lag = i[:, None] - 1 - np.arange(size)[None, :]
    return np.where(lag >= 0, power[np.maximum(lag, 0)], 0.0), power


def recursion(x: np.ndarray, beta: float, first: float) -> np.ndarray:
    """y[0] = first, y[t] = x[t-1] + beta y[t-1], for t up to len(x): one more value than x."""
    n = len(x)
    size = min(BLOCK, max(n, 1))
    blocks = -(-n // size)
    padded = np.zeros(blocks * size)
    padded[:n] = x
    lower, power = _powers(float(beta), size)
    inside = lower @ padded.reshape(blocks, size).T  # (size + 1, blocks)
    starts = np.empty(blocks + 1)
    starts[0] = carry = first
    for k, (end, p) in enumerate(zip(inside[size].tolist(), [float(power[size])] * blocks, strict=True)):
        carry = end + p * carry
        starts[k + 1] = carry
    y = (inside[:size] + power[:size, None] * starts[None, :blocks]).T.ravel()[:n]
    tail = n - (blocks - 1) * size if blocks else 0
    last = inside[tail, -1] + power[tail] * starts[blocks - 1] if blocks else first
    return np.append(y, last)


def mean_square(r: np.ndarray) -> float:
    total = 0.0
    for x in r.tolist():  # the order of the SQL scan
        total += x * x
    return total / len(r)


def likelihood(x: np.ndarray, alpha: float, beta: float, nu: float | None, h_first: float) -> tuple[float, float]:
    """Log-likelihood of squared returns ``x`` and the variance that follows."""
    h = recursion(alpha * x, beta, h_first)
    with np.errstate(all="ignore"):
        if nu is None:
            ll = -0.5 * (len(x) * LN_2PI + np.log(h[:-1]).sum() + (x / h[:-1]).sum())
        else:
            c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
            ll = len(x) * c - 0.5 * np.log(h[:-1]).sum() - (nu + 1) / 2 * np.log1p(x / (h[:-1] * (nu - 2))).sum()
    return float(ll), float(h[-1])


def derivatives(x: np.ndarray, alpha: float, beta: float, nu: float | None, h_first: float):
    """(log-likelihood, next variance, scores (n, k), Hessian (k, k)) in alpha, beta[, nu]."""
    h_all = recursion(alpha * x, beta, h_first)
    ha_all = recursion(x, beta, 0.0)
    hb_all = recursion(h_all[:-1], beta, 0.0)
    hab = recursion(ha_all[:-1], beta, 0.0)[:-1]
    hbb = recursion(2 * hb_all[:-1], beta, 0.0)[:-1]
    h = h_all[:-1]
    with np.errstate(all="ignore"):
        # all derivatives of h as shares of h, so that tiny variances don't overflow
        a, b, ab, bb, y = ha_all[:-1] / h, hb_all[:-1] / h, hab / h, hbb / h, x / h
        if nu is None:
            ll = -0.5 * (len(x) * LN_2PI + np.log(h).sum() + y.sum())
            by_h = 0.5 * (y - 1)
            by_hh = 0.5 - y
            scores = np.stack([by_h * a, by_h * b], axis=1)
        else:
            k, half = nu - 2, (nu + 1) / 2
            total = k + y
            c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * k)
            c1 = 0.5 * digamma((nu + 1) / 2) - 0.5 * digamma(nu / 2) - 0.5 / k
            c2 = 0.25 * trigamma((nu + 1) / 2) - 0.25 * trigamma(nu / 2) + 0.5 / (k * k)
            log_term = np.log1p(y / k)
            ll = len(x) * c - 0.5 * np.log(h).sum() - half * log_term.sum()
            by_h = half * y / total - 0.5
            by_hh = 0.5 - half * y * (2 * k + y) / (total * total)
            by_n = c1 - 0.5 * log_term + half * y / (k * total)
            by_nn = c2 + y / (k * total) - half * y * (2 * k + y) / (k * k * total * total)
            by_hn = 0.5 * y / total - half * y / (total * total)
            scores = np.stack([by_h * a, by_h * b, by_n], axis=1)
        size = scores.shape[1]
        hess = np.empty((size, size))
        hess[0, 0] = (by_hh * a * a).sum()
        hess[0, 1] = hess[1, 0] = (by_hh * a * b + by_h * ab).sum()
        hess[1, 1] = (by_hh * b * b + by_h * bb).sum()
        if nu is not None:
            hess[0, 2] = hess[2, 0] = (by_hn * a).sum()
            hess[1, 2] = hess[2, 1] = (by_hn * b).sum()
            hess[2, 2] = by_nn.sum()
    return float(ll), float(h_all[-1]), scores, hess


# ---------------------------------------------------------------- the search


def _inside(point: np.ndarray) -> np.ndarray:
    """The nearest allowed (alpha, persistence[, 1/nu])."""
    out = point.copy()
    out[1] = min(max(out[1], 0.0), MAX_PERSISTENCE)
    out[0] = min(max(out[0], 0.0), out[1])
    if len(out) > 2:
        out[2] = min(max(out[2], 1 / NU_BOUNDS[1]), 1 / NU_BOUNDS[0])
    return out


def model(point: np.ndarray) -> tuple[float, float, float | None]:
    """alpha, beta, nu of a point; nu is exact at its bounds."""
    nu = None
    if len(point) > 2:
        nu = NU_BOUNDS[1] if point[2] <= 1 / NU_BOUNDS[1] else NU_BOUNDS[0] if point[2] >= 1 / NU_BOUNDS[0] else 1 / point[2]
    return float(point[0]), float(point[1] - point[0]), nu


def _in_search_space(scores: np.ndarray, hess: np.ndarray, nu: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian in (alpha, persistence[, 1/nu]) from those in (alpha, beta[, nu])."""
    turn = np.eye(len(hess))
    turn[1, 0] = -1.0
    g = scores.sum(axis=0)
    extra = 0.0
    if nu is not None:
        turn[2, 2] = -nu * nu
        extra = 2 * nu**3 * g[2]
    out = turn.T @ hess @ turn
    if nu is not None:
        out[2, 2] += extra
    return turn.T @ g, out


def _step(point: np.ndarray, g: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """A climbing Newton step of the coordinates that no bound holds."""
    held = ((point <= 0) & (g < 0)) | ((point >= MAX_PERSISTENCE) & (g > 0))
    if len(point) > 2:
        held[2] = (point[2] <= 1 / NU_BOUNDS[1] and g[2] < 0) or (point[2] >= 1 / NU_BOUNDS[0] and g[2] > 0)
    step = np.zeros_like(point)
    if not held[0] and point[0] >= point[1] and g[0] > 0 and not held[1]:
        # beta = 0 holds: alpha and persistence move together
        along = np.zeros((len(point), len(point) - 1))
        along[0, 0] = along[1, 0] = 1.0
        if len(point) > 2:
            along[2, 1] = float(not held[2])
    else:
        along = np.eye(len(point))[:, ~held]
    along = along[:, np.abs(along).sum(axis=0) > 0]
    if not along.shape[1]:
        return step
    value, vector = np.linalg.eigh(along.T @ hess @ along)
    least = max(np.abs(value).max() * 1e-12, 1e-300)
    step = along @ (vector @ ((vector.T @ (along.T @ g)) / np.maximum(np.abs(value), least)))
    over = np.max(np.abs(step) / np.array(LONGEST[: len(step)]))
    return step / over if over > 1 else step


def maximise(r: np.ndarray, alpha: float, persistence: float, nu: float | None):
    """(theta, log-likelihood, next variance, steps, converged) of the maximum that climbing from a start ends in.

    theta: alpha, persistence[, nu]. A sample without rows or with a null return has no fit.
    """
    r = np.asarray(r, dtype=float)
    size = 2 if nu is None else 3
    if not len(r) or not np.isfinite(r).all():
        return np.full(size, np.nan), np.nan, np.nan, 0, False
    x, h_first = r * r, mean_square(r)
    point = _inside(np.array([alpha, persistence] + ([] if nu is None else [1 / nu])))
    steps, converged = 0, False
    ll = -math.inf
    for steps in range(1, MOST_STEPS + 1):
        ll, h_next, scores, hess = derivatives(x, *model(point), h_first)
        if not math.isfinite(ll) or not np.isfinite(hess).all():
            break
        g, curve = _in_search_space(scores, hess, model(point)[2])
        step = _step(point, g, curve)
        for halved in range(HALVINGS):
            new = _inside(point + step / 2**halved)
            if np.max(np.abs(new - point)) <= NO_MOVE:
                converged = True
                break
            new_ll, _ = likelihood(x, *model(new), h_first)
            # near the top the rise is below rounding: a full step is then taken on the gradient's word
            if new_ll > ll or (halved == 0 and abs(new_ll - ll) <= 1e-11 * max(1.0, abs(ll)) and np.max(np.abs(new - point)) < 1e-5):
                break
        else:
            converged = True
        if converged:
            break
        point = new
    a, b, n = model(point)
    if not math.isfinite(ll):
        return np.full(size, np.nan), np.nan, np.nan, steps, False
    ll, h_next = likelihood(x, a, b, n, h_first)
    return np.array([a, point[1]] + ([] if n is None else [n])), ll, h_next, steps, converged


def sandwich_se(r: np.ndarray, theta: np.ndarray):
    """Robust standard errors of (alpha, beta[, nu]): roots of the diagonal of H^-1 (S'S) H^-1, and whether a bound is met.

    H is the Hessian of the log-likelihood, S its scores by row. At a bound the usual theory does not hold.
    """
    r = np.asarray(r, dtype=float)
    a, p = float(theta[0]), float(theta[1])
    nu = float(theta[2]) if len(theta) > 2 else None
    _, _, scores, hess = derivatives(r * r, a, p - a, nu, mean_square(r))
    at_bound = a <= 0 or p - a <= 0 or p >= MAX_PERSISTENCE or (nu is not None and not NU_BOUNDS[0] < nu < NU_BOUNDS[1])
    try:
        inverse = np.linalg.inv(hess)
        var = np.diag(inverse @ (scores.T @ scores) @ inverse)
        se = np.sqrt(np.where(var >= 0, var, np.nan))
    except np.linalg.LinAlgError:
        se = np.full(len(hess), np.nan)
    return se, bool(at_bound)
