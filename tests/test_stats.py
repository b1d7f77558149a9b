import math

import numpy as np
import pandas as pd

from sigmaflow.functions.stats import normal_two_sided_p, t_two_sided_p
from sigmaflow.operators import evaluate as ev


def test_t_p_values_against_tables(spark):
    cases = [(2.228, 10, 0.05), (12.706, 1, 0.05), (4.303, 2, 0.05), (2.042, 30, 0.05), (2.576, 100000, 0.01)]
    df = spark.createDataFrame([(t, d) for t, d, _ in cases], "t double, df long")
    got = df.select(t_two_sided_p("t", "df").alias("p")).toPandas()["p"].to_numpy()
    assert np.allclose(got, [c[2] for c in cases], atol=2e-4)


def test_normal_tail():
    assert abs(normal_two_sided_p(1.959963984540054) - 0.05) < 1e-12
    assert normal_two_sided_p(0.0) == 1.0


def test_mz_regression_matches_closed_form_ols(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(1, 2, 40)
    y = 0.3 + 0.8 * x + rng.normal(0, 0.1, 40)
    pdf = pd.DataFrame({"series": "s", "distribution": "Normal", "forc_style": "5min",
                        "daily_variance_forecast": x, "realized_variance": y})
    perf = spark.createDataFrame(pdf)
    tidy = ev.mz_tidy(perf, "realized_variance").toPandas().set_index("term")
    glance = ev.mz_glance(perf, "realized_variance").toPandas().iloc[0]
    X = np.column_stack([np.ones_like(x), x])
    beta, res, *_ = np.linalg.lstsq(X, y, rcond=None)
    sigma2 = res[0] / (len(x) - 2)
    se = np.sqrt(np.diag(sigma2 * np.linalg.inv(X.T @ X)))
    assert np.allclose(tidy.loc["(Intercept)", ["estimate", "std_error"]], [beta[0], se[0]])
    assert np.allclose(tidy.loc["daily_variance_forecast", ["estimate", "std_error"]], [beta[1], se[1]])
    r2 = 1 - res[0] / np.sum((y - y.mean()) ** 2)
    assert math.isclose(glance["r_squared"], r2, rel_tol=1e-9)
    ll = -len(x) / 2 * (math.log(2 * math.pi) + math.log(res[0] / len(x)) + 1)
    assert math.isclose(glance["loglik"], ll, rel_tol=1e-9)
    assert 0 <= glance["p_value"] < 1e-6
