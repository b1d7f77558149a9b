"""Rolling windows on a gapless 5-minute calendar and GARCH kernels on simulated data."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaflow.config import Params
from sigmaflow.operators import garch as G
from sigmaflow.operators import timeseries as ts
from sigmaflow.operators import windows as W
from sigmaflow.operators.garch_kernel import grid_scan, refine, scan
from sigmaflow.operators.garch_newton import maximise, sandwich_se

REF = Params(start=dt.datetime(2016, 1, 1), end=dt.datetime(2017, 10, 19, 23, 59, 59),
             forecast_start=dt.datetime(2017, 6, 30, 23, 55, 0), excluded_day=None)


@pytest.fixture(scope="module")
def grid_returns(spark):
    """658 days of gapless one-minute prices, resampled to 5-minute bars: the calendar
    of the original study."""
    n = 658 * 1440
    minutes = (spark.range(n).select(
        F.lit("btc").alias("series"),
        F.expr("timestampadd(MINUTE, CAST(id AS INT), TIMESTAMP_NTZ'2016-01-01 00:00:00')").alias("date"),
        (F.lit(1000.0) + F.col("id") % 97).alias("adjusted"),
        F.col("id").alias("tick_id")))
    bars = ts.resample_bars(minutes)
    assert bars.count() == 189_504
    return ts.log_returns(bars, bucket="day")


def test_gapless_calendar_counts(grid_returns):
    assert grid_returns.count() == 189_503
    days = W.day_table(grid_returns)
    win = W.rolling_windows(grid_returns, REF, days).orderBy("window_id").toPandas()
    assert len(win) == 111
    assert (win["n_ahead"] == 288).all()
    assert win["n_fit"].iloc[0] == 157_535
    assert (win["n_fit"].iloc[1:] == 157_536).all()
    assert str(win["target_day"].iloc[0].date()) == "2017-07-01"
    assert str(win["target_day"].iloc[-1].date()) == "2017-10-19"
    ins = W.in_sample_window(grid_returns, REF, days).toPandas()
    assert ins["n_fit"].iloc[0] == 157_535


def test_window_arrays_follow_time_order(spark, grid_returns):
    days = W.day_table(grid_returns)
    win = W.rolling_windows(grid_returns, REF, days).where("window_id IN (1, 111)")
    arr = W.window_arrays(win, W.day_arrays(grid_returns, days)).orderBy("window_id").toPandas()
    rows = W.window_rows(win, grid_returns, days).orderBy("window_id").toPandas()
    for (_, a), (_, w) in zip(arr.iterrows(), rows.iterrows()):
        r = np.asarray(a["r"])
        assert len(r) == w["n_rows"]
        assert np.isclose(np.sum(r * r), w["sum_sq"])


def _simulate(alpha, beta, n, seed):
    rng = np.random.default_rng(seed)
    h, r = 1.0, np.empty(n)
    for t in range(n):
        r[t] = np.sqrt(h) * rng.standard_normal()
        h = alpha * r[t] ** 2 + beta * h
    return r


def test_scan_matches_sql_aggregate(spark):
    r = _simulate(0.08, 0.919, 500, 11)
    samples = spark.createDataFrame([("s", 0, r.tolist())], "series string, window_id int, r array<double>")
    sql = G.grid_loglik(samples, ["series", "window_id"]).toPandas()
    g = {c: sql[c].to_numpy(dtype=float) for c in ("alpha", "beta")}
    g["nu"] = sql["nu"].to_numpy(dtype=float)
    ll, h = grid_scan(r, g)
    assert np.allclose(ll, sql["loglik"].to_numpy(), rtol=1e-11)
    assert np.allclose(h, sql["h_next"].to_numpy(), rtol=1e-11)
    fits = G.grid_fit_numpy(samples, ["series", "window_id"]).toPandas()
    best = G.grid_fit(G.grid_loglik(samples, ["series", "window_id"]), ["series", "window_id"]).toPandas()
    m = fits.merge(best, on=["series", "window_id", "distribution"])
    assert np.allclose(m["alpha_x"], m["alpha_y"]) and np.allclose(m["persistence_x"], m["persistence_y"])


def test_mle_recovers_parameters_and_beats_grid():
    alpha, beta = 0.08, 0.919
    r = _simulate(alpha, beta, 4000, 5)
    theta, ll, _, _, done = refine(r, 0.05, 0.99, None)
    assert abs(theta[0] - alpha) < 0.03
    assert abs(theta[1] - (alpha + beta)) < 0.01
    grid_ll, _, _ = scan(r, np.array([0.05]), np.array([0.94]), None)
    assert ll >= grid_ll[0]
    se, _ = sandwich_se(r, theta)
    assert np.all(np.isfinite(se)) and np.all(se > 0)


def test_student_t_fit_on_heavy_tails():
    rng = np.random.default_rng(9)
    n, alpha, beta, nu = 3000, 0.1, 0.899, 5.0
    h, r = 1.0, np.empty(n)
    for t in range(n):
        z = rng.standard_t(nu) / np.sqrt(nu / (nu - 2))
        r[t] = np.sqrt(h) * z
        h = alpha * r[t] ** 2 + beta * h
    theta, ll_t, *_ = refine(r, 0.08, 0.99, 10.0)
    _, ll_n, *_ = refine(r, 0.08, 0.99, None)
    assert ll_t > ll_n
    assert 3.0 < theta[2] < 9.0


def test_nstep_sum_equals_geometric_closed_form(spark):
    fits = spark.createDataFrame([("s", 2.0, 0.95, 288)], "series string, h_next double, persistence double, n_ahead long")
    got = fits.select(G.daily_variance_expr().alias("v")).first()["v"]
    assert np.isclose(got, 2.0 * (1 - 0.95 ** 288) / (1 - 0.95))
    steps = G.nstep_forecast(fits).toPandas()
    assert len(steps) == 288 and np.isclose((steps["sigma"] ** 2).sum(), got)


def test_window_blocks_give_the_same_fits_as_single_windows(spark):
    from sigmaflow.plans.garch_jobs import FitInputs
    r = _simulate(0.06, 0.93, 40 * 48, 21)
    rows = [("s", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=30 * i), float(x)) for i, x in enumerate(r)]
    rets = (spark.createDataFrame(rows, "series string, date timestamp_ntz, return double")
            .withColumn("day", F.to_date("date").cast("timestamp_ntz")))
    params = Params(start=dt.datetime(2020, 1, 1), end=dt.datetime(2020, 2, 9, 23, 59, 59),
                    forecast_start=dt.datetime(2020, 1, 30, 23, 55), excluded_day=None)
    fi = FitInputs(rets, params)
    keys = ["series", "window_id"]
    one = G.grid_fit_numpy(fi.samples(fi.windows), keys).toPandas()
    for per_block in (3, 16):
        blk = G.grid_fit_numpy(fi.blocks(fi.windows, per_block), keys).toPandas()
        m = one.merge(blk, on=["series", "window_id", "distribution"])
        assert len(m) == len(one) == 20
        assert np.allclose(m["loglik_x"], m["loglik_y"], rtol=1e-12)
        assert (m["n_obs_x"] == m["n_obs_y"]).all()


def test_mle_query_equals_direct_fit_on_collected_samples(spark):
    import __spark_entry__ as E
    from sigmaflow.config import TICK_PARAMS
    from sigmaflow.plans.inputs import TickInputs
    from tests.conftest import SF_SMALL

    got = E.queries()["garch_mle_fit"](spark, SF_SMALL).where("sampling = '5min'").toPandas()
    rets = TickInputs(spark, SF_SMALL).returns_5min.toPandas()
    origin = np.datetime64(TICK_PARAMS.origin_day)
    for _, row in got.iterrows():
        s = rets[(rets.series == row.series) & (rets.day.values.astype("datetime64[D]") <= origin)]
        r = s.sort_values("date")["return"].to_numpy()
        assert len(r) == row.n_obs
        g = G._grid_arrays(None, G.DEFAULT_GRID, (row.distribution,))
        from sigmaflow.operators.garch_kernel import grid_scan
        ll, _ = grid_scan(r, g)
        i = int(np.argmax(ll))
        nu0 = None if row.distribution == "Normal" else g["nu"][i]
        theta, best, *_ = maximise(r, g["alpha"][i], g["persistence"][i], nu0)
        assert np.isclose(best, row.loglik, atol=1e-6)
        assert np.isclose(theta[0], row.alpha, atol=1e-6)
        plain, plain_best, *_ = refine(r, g["alpha"][i], g["persistence"][i], nu0)
        assert plain_best <= row.loglik + 1e-6 and np.isclose(plain_best, row.loglik, atol=1e-4)


def test_null_return_gives_a_null_fit_that_says_so(spark):
    df = spark.createDataFrame([("a", 0, [0.1, None, 0.2]), ("b", 0, [0.1, -0.2, 0.2, 0.05])], "series string, window_id long, r array<double>")
    rows = {(r.series, r.distribution): r for r in G.mle_fit_numpy(df, ["series", "window_id"]).collect()}
    assert not rows["a", "Normal"].converged and rows["a", "Student-t"].alpha is None
    assert rows["b", "Normal"].converged and rows["b", "Normal"].loglik is not None


def test_search_ends_converged_on_flat_likelihoods():
    r = np.array([1.0, -1.0] * 200)
    theta, ll, _, rounds, converged = refine(r, 0.05, 0.99, 4.0)
    assert converged and np.isfinite(ll) and theta[2] == 100.0
