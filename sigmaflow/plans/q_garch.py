"""Registered queries: rolling windows and grid-QMLE GARCH fits and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmaflow.config import DAILY_PARAMS, TICK_PARAMS
from sigmaflow.operators import garch as G
from sigmaflow.operators import windows as W
from sigmaflow.plans import evaluation as E
from sigmaflow.plans import garch_jobs as J
from sigmaflow.plans import inputs as inp
from sigmaflow.plans.q_evaluation import STYLES_FILTERED, STYLES_MAIN
from sigmaflow.plans.registry import register


def intraday(spark, sf_dir, filtered=False):
    ctx = inp.TickInputs(spark, sf_dir)
    return J.FitInputs(ctx.returns_5min_filtered if filtered else ctx.returns_5min, TICK_PARAMS)


def daily(spark, sf_dir):
    return J.FitInputs(inp.returns_daily_orders(spark, sf_dir), DAILY_PARAMS)


@register("day_ends")
def day_ends(spark, sf_dir):
    return W.day_ends(inp.TickInputs(spark, sf_dir).returns_5min)


@register("rolling_windows")
def rolling_windows(spark, sf_dir):
    return intraday(spark, sf_dir).windows


@register("window_rows")
def window_rows(spark, sf_dir):
    fi = intraday(spark, sf_dir)
    return W.window_rows(fi.windows, fi.returns, fi.days)


@register("forecast_horizon")
def forecast_horizon(spark, sf_dir):
    return intraday(spark, sf_dir).windows.select("series", "window_id", "target_day", "n_ahead")


@register("garch_loglik_normal", digits=4)
def garch_loglik_normal(spark, sf_dir):
    return J.grid_loglik_table(spark, daily(spark, sf_dir), distributions=("Normal",)).drop("window_id")


@register("garch_loglik_t", digits=4)
def garch_loglik_t(spark, sf_dir):
    return J.grid_loglik_table(spark, daily(spark, sf_dir), distributions=("Student-t",)).drop("window_id")


@register("garch_grid_fit", digits=4)
def garch_grid_fit(spark, sf_dir):
    """In-sample grid fit of the daily series, both distributions."""
    return J.in_sample_grid_fit(spark, daily(spark, sf_dir)).drop("window_id")


@register("garch_grid_fit_5min", digits=4)
def garch_grid_fit_5min(spark, sf_dir):
    return J.in_sample_grid_fit(spark, intraday(spark, sf_dir)).drop("window_id")


@register("garch_nstep_forecast")
def garch_nstep_forecast(spark, sf_dir):
    """sigma per 5-minute step of the first out-of-sample day, from the in-sample fit."""
    fits = J.in_sample_grid_fit(spark, intraday(spark, sf_dir))
    return G.nstep_forecast(fits).select("series", "distribution", F.col("target_day").alias("day"),
                                         "step", "sigma")


@register("garch_daily_variance")
def garch_daily_variance(spark, sf_dir):
    fits = J.in_sample_grid_fit(spark, intraday(spark, sf_dir))
    steps = G.nstep_forecast(fits).withColumnRenamed("target_day", "day")
    return G.daily_variance(steps, ["series", "distribution", "day"])


ROLL_COLS = ("series", "distribution", "forc_style", "day", "window_id", "alpha", "beta", "nu", "loglik",
             "daily_variance_forecast")


@register("garch_roll_daily_grid", overrides={"loglik": 4})
def garch_roll_daily_grid(spark, sf_dir):
    """Daily series: moving-window refit every day, one-step-ahead forecast."""
    return J.rolling_grid_forecast(spark, daily(spark, sf_dir), "daily").select(*ROLL_COLS)


@register("garch_roll_intraday_grid", overrides={"loglik": 4})
def garch_roll_intraday_grid(spark, sf_dir):
    """5-minute series: daily refit, next day's steps summed to a daily variance."""
    return J.rolling_grid_forecast(spark, intraday(spark, sf_dir), "5min").select(*ROLL_COLS)


@register("garch_roll_filtered_grid", overrides={"loglik": 4})
def garch_roll_filtered_grid(spark, sf_dir):
    """Same on outlier-replaced 5-minute returns."""
    return J.rolling_grid_forecast(spark, intraday(spark, sf_dir, True), "5min_filtered").select(*ROLL_COLS)


@register("garch_mle_fit")
def garch_mle_fit(spark, sf_dir):
    """Refined in-sample ML fits: 5-minute returns of the tick series, daily returns of the order series."""
    five = J.in_sample_mle(intraday(spark, sf_dir), with_se=False).withColumn("sampling", F.lit("5min"))
    day = J.in_sample_mle(daily(spark, sf_dir), with_se=False).withColumn("sampling", F.lit("daily"))
    cols = ["series", "sampling", "distribution", "alpha", "persistence", "beta", "nu", "loglik",
            "grid_loglik", "h_next", "n_obs", "converged"]
    return five.select(*cols).unionByName(day.select(*cols))


@register("garch_coef_table", overrides={"robust_se": 12})
def garch_coef_table(spark, sf_dir):
    """Four models per series: robust coefficient rows for Normal and Student-t, 5-minute and daily."""
    five = J.coefficient_table(J.in_sample_mle(intraday(spark, sf_dir)), "5min")
    day = J.coefficient_table(J.in_sample_mle(daily(spark, sf_dir)), "daily")
    return five.unionByName(day)


@register("garch_roll_mle", overrides={"loglik": 4})
def garch_roll_mle(spark, sf_dir):
    """Rolling refined-ML refits of the 5-minute series with next-day variance forecasts."""
    return J.rolling_mle_forecast(spark, intraday(spark, sf_dir), "5min").select(*ROLL_COLS)


STYLE_SEP = "\u0001"


ALL_STYLES = ("5min", "5min_filtered", "daily")
MAIN_STYLES = ("5min", "daily")


def garch_forecasts(spark, sf_dir, ctx=None, refined=False, styles=ALL_STYLES):
    """Rolling forecasts of the wanted styles on the same tick series (grid QMLE, or
    refined ML with ``refined``); only those styles are fitted.

    The return tables are stacked under a composite key ``series + style`` so
    one set of window, block and fit stages serves all styles; the key is split back
    afterwards.
    """
    ctx = ctx or inp.TickInputs(spark, sf_dir)
    roll = J.rolling_mle_forecast if refined else J.rolling_grid_forecast
    returns = {"5min": lambda: ctx.returns_5min, "5min_filtered": lambda: ctx.returns_5min_filtered, "daily": lambda: ctx.returns_daily}
    stacked = None
    for style in styles:
        part = returns[style]().select(F.concat_ws(STYLE_SEP, "series", F.lit(style)).alias("series"), "day", "date", "return")
        stacked = part if stacked is None else stacked.unionByName(part)
    fc = roll(spark, J.FitInputs(stacked, TICK_PARAMS), "stacked")
    key = F.split(F.col("series"), STYLE_SEP)
    return fc.select(key[0].alias("series"), "distribution", key[1].alias("forc_style"), "day",
                     "daily_variance_forecast")


def _with_forecasts(spark, sf_dir, styles, refined=False):
    ctx = inp.TickInputs(spark, sf_dir)
    return ctx, garch_forecasts(spark, sf_dir, ctx, refined, styles)


@register("garch_all_forecasts")
def garch_all_forecasts(spark, sf_dir):
    return garch_forecasts(spark, sf_dir)


@register("garch_performance_data")
def garch_performance_data(spark, sf_dir):
    ctx, fc = _with_forecasts(spark, sf_dir, MAIN_STYLES)
    return E.performance_data(fc, ctx.rv, ctx.sq, TICK_PARAMS)


@register("garch_performance_data_filtered")
def garch_performance_data_filtered(spark, sf_dir):
    ctx, fc = _with_forecasts(spark, sf_dir, ALL_STYLES)
    return E.performance_data_filtered(fc, ctx.rv, ctx.sq)


@register("garch_compare_styles_long")
def garch_compare_styles_long(spark, sf_dir):
    ctx, fc = _with_forecasts(spark, sf_dir, MAIN_STYLES)
    return E.compare_styles_long(fc, ctx.rv)


@register("garch_compare_dists_long")
def garch_compare_dists_long(spark, sf_dir):
    ctx, fc = _with_forecasts(spark, sf_dir, ("5min",))
    return E.compare_dists_long(fc, ctx.rv)


@register("garch_compare_filtered_long")
def garch_compare_filtered_long(spark, sf_dir):
    ctx, fc = _with_forecasts(spark, sf_dir, ("5min", "5min_filtered"))
    return E.compare_filtered_long(fc, ctx.rv)


@register("garch_result_table")
def garch_result_table(spark, sf_dir):
    """The paper's metric table (MAPE, RMSE, MZ coefficients, R^2) from GARCH forecasts."""
    ctx, fc = _with_forecasts(spark, sf_dir, MAIN_STYLES)
    return E.result_table(E.performance_data(fc, ctx.rv, ctx.sq, TICK_PARAMS), STYLES_MAIN)


@register("garch_result_table_filtered")
def garch_result_table_filtered(spark, sf_dir):
    """The metric table of the model on outlier-replaced returns."""
    ctx, fc = _with_forecasts(spark, sf_dir, ("5min_filtered",))
    return E.result_table(E.performance_data_filtered(fc, ctx.rv, ctx.sq), STYLES_FILTERED)


@register("garch_result_table_mle")
def garch_result_table_mle(spark, sf_dir):
    """The paper's metric table from refined maximum-likelihood rolling forecasts."""
    ctx, fc = _with_forecasts(spark, sf_dir, MAIN_STYLES, refined=True)
    return E.result_table(E.performance_data(fc, ctx.rv, ctx.sq, TICK_PARAMS), STYLES_MAIN)


@register("garch_models", digits=4)
def garch_models(spark, sf_dir):
    """The model table: spec columns of each distribution attached to every series' in-sample fit."""
    specs = G.model_specs(spark)  # two rows by definition
    fits = J.in_sample_grid_fit(spark, intraday(spark, sf_dir))
    return (fits.join(F.broadcast(specs), "distribution", "inner")
            .select("series", "distribution", "model", "garch_p", "garch_q", "include_mean", "omega",
                    "dist_code", "n_obs", "alpha", "beta", "nu", "loglik"))
