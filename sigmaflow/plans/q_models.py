"""Registered queries: variance paths, saved models, resumed forecasts, time slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmaflow.config import TICK_PARAMS
from sigmaflow.operators import slices as S
from sigmaflow.plans import garch_jobs as J
from sigmaflow.plans import inputs as inp
from sigmaflow.plans import model_jobs as M
from sigmaflow.plans.q_garch import daily, intraday
from sigmaflow.plans.registry import register
from sigmaflow.session import materialize, scratch_path
from sigmaflow.sources.model_store import ModelStore

# Fixed values of the slices that the queries cut: they begin and end at no bar's edge.
SLICE_AFTER, SLICE_LENGTH = 3_661, 300_007


def _grid_fits(spark, fi):
    return materialize(J.in_sample_grid_fit(spark, fi), "grid-fits")


@register("garch_variance_path")
def garch_variance_path(spark, sf_dir):
    """Variance, sigma and standardised return of every 5-minute bar under the in-sample grid fits."""
    fi = intraday(spark, sf_dir)
    path = M.fitted_path(_grid_fits(spark, fi), fi.returns, fi.params)
    return path.select("series", "distribution", "date", "h", "sigma", "std_resid", "in_sample")


@register("garch_variance_path_mle")
def garch_variance_path_mle(spark, sf_dir):
    """The same for the daily returns of the order series under the refined fits: thousands of days, one bar each."""
    fi = daily(spark, sf_dir)
    fits = materialize(J.in_sample_mle(fi, with_se=False), "mle-fits")
    path = M.fitted_path(fits, fi.returns, fi.params)
    return path.select("series", "distribution", "date", "h", "sigma", "std_resid", "in_sample")


def _stored(spark, sf_dir):
    fi = intraday(spark, sf_dir)
    store = M.save_states(spark, scratch_path(spark, "model-store"), _grid_fits(spark, fi), fi.returns, fi.params)
    return fi, ModelStore(spark, store.root)


@register("model_store_states", overrides={"loglik": 4})
def model_store_states(spark, sf_dir):
    """Fitted models saved, then those of one series replaced by their state after all bars; the store's table."""
    fi, store = _stored(spark, sf_dir)
    first = store.read()
    one = first.groupBy().agg(F.min("series").alias("series"))  # one row
    store.save(M.advanced(first, fi.returns).join(one, "series", "left_semi"))
    return store.read().select("part", "series", "distribution", "alpha", "beta", "nu", "loglik", "n_obs", "last_date", "r_last", "h_last", "h_next")


@register("model_store_resumed_forecast")
def model_store_resumed_forecast(spark, sf_dir):
    """Daily variance forecasts of all days after the origin from the saved states alone, without a refit."""
    fi, store = _stored(spark, sf_dir)
    return M.resumed_forecasts(store.read(), fi.returns)


@register("time_slice_sums")
def time_slice_sums(spark, sf_dir):
    """Count, sums and ends of the 5-minute returns of slices that begin and end at any second."""
    returns = inp.TickInputs(spark, sf_dir).returns_5min
    return S.slice_sums(returns, S.day_slices(returns, SLICE_AFTER, SLICE_LENGTH), "return")


@register("time_slice_rows")
def time_slice_rows(spark, sf_dir):
    """The rows of those slices."""
    returns = inp.TickInputs(spark, sf_dir).returns_5min
    return S.slice_rows(returns.select("series", "date", "return"), S.day_slices(returns, SLICE_AFTER, SLICE_LENGTH))
