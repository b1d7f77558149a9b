"""Distribution tails without scipy.

``t_two_sided_p`` is a pure SQL expression (higher-order ``aggregate`` over a
``sequence``), so regression p-values stay inside the JVM. It uses the finite
trigonometric series for the Student-t CDF at integer degrees of freedom
(Abramowitz & Stegun 26.7.3-4), exact up to floating point.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def t_tail_sql(t: str, df: str, dialect: str = "spark") -> str:
    """SQL text for P(|T_df| >= |t|); ``dialect`` is 'spark' or 'duckdb'."""

    def lam(args: str, body: str) -> str:
        if dialect == "spark":
            return f"({args}) -> {body}" if "," in args else f"{args} -> {body}"
        return f"lambda {args}: {body}"

    th = f"atan(abs({t}) / sqrt({df}))"
    c2 = f"pow(cos({th}), 2)"
    if dialect == "spark":
        seq_even = f"filter(sequence(1, greatest(CAST(({df} - 2) DIV 2 AS INT), 1)), {lam('j', f'j <= ({df} - 2) DIV 2')})"
        seq_odd = f"filter(sequence(1, greatest(CAST(({df} - 3) DIV 2 AS INT), 1)), {lam('j', f'j <= ({df} - 3) DIV 2')})"
        init = "named_struct('t', CAST(1 AS DOUBLE), 's', CAST(1 AS DOUBLE))"

        def step(ratio: str) -> str:
            nxt = f"acc.t * {ratio} * {c2}"
            return lam("acc, j", f"named_struct('t', {nxt}, 's', acc.s + {nxt})")

        even_sum = f"aggregate({seq_even}, {init}, {step('(2 * j - 1) / (2.0D * j)')}, {lam('acc', 'acc.s')})"
        odd_sum = f"aggregate({seq_odd}, {init}, {step('(2.0D * j) / (2 * j + 1)')}, {lam('acc', 'acc.s')})"
        pi = "pi()"
    else:
        seq_even = f"range(1, CAST(({df} - 2) // 2 AS BIGINT) + 1)"
        seq_odd = f"range(1, CAST(greatest(({df} - 3) // 2, 0) AS BIGINT) + 1)"
        init = "{'t': CAST(1 AS DOUBLE), 's': CAST(1 AS DOUBLE)}"

        def step(ratio: str) -> str:
            nxt = f"acc.t * {ratio} * {c2}"
            return lam("acc, j", f"{{'t': {nxt}, 's': acc.s + {nxt}}}")

        even_sum = f"list_reduce({seq_even}, {step('(2 * j - 1) / (2.0 * j)')}, {init}).s"
        odd_sum = f"list_reduce({seq_odd}, {step('(2.0 * j) / (2 * j + 1)')}, {init}).s"
        pi = "pi()"
    a_even = f"sin({th}) * {even_sum}"
    a_odd = (f"CASE WHEN {df} = 1 THEN 2 * {th} / {pi} "
             f"ELSE 2 / {pi} * ({th} + sin({th}) * cos({th}) * {odd_sum}) END")
    return (f"CASE WHEN {t} IS NULL OR {df} IS NULL OR {df} < 1 THEN NULL "
            f"WHEN {df} % 2 = 0 THEN 1 - ({a_even}) ELSE 1 - ({a_odd}) END")


def t_two_sided_p(t: str, df: str) -> Column:
    """Column: two-sided Student-t p-value for statistic column ``t`` with ``df`` (integer) dof."""
    return F.expr(t_tail_sql(t, df, "spark"))


def normal_two_sided_p(z: np.ndarray | float) -> np.ndarray:
    """2 * (1 - Phi(|z|)) for numpy input (used inside pandas UDF kernels)."""
    z = np.abs(np.asarray(z, dtype=float))
    return np.vectorize(lambda v: math.erfc(v / math.sqrt(2.0)) if np.isfinite(v) else np.nan)(z)



# Rational approximation of the normal tail (absolute error below 1e-7).
NORMAL_TAIL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_two_sided_sql(z: str) -> str:
    """Two-sided normal p-value of ``z``, as text that Spark and DuckDB read alike."""
    b0, *b = NORMAL_TAIL
    k = f"(1 / (1 + {b0!r} * abs({z})))"
    poly = "0"
    for c in reversed(b):
        poly = f"({c!r} + {k} * {poly})"
    return f"(2 * exp(-0.5 * {z} * {z}) / sqrt(2 * pi()) * {k} * {poly})"


def significant_sql(x: str, digits: int = 4) -> str:
    """``x`` at that many significant digits, as text that Spark and DuckDB read alike."""
    unit = f"pow(10, floor(log10(abs({x}))) - {digits - 1})"
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE round({x} / {unit}) * {unit} END)"
