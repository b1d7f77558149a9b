"""Forecast evaluation: error metrics and Mincer-Zarnowitz regressions.

All of it is plain hash aggregation with ``regr_*`` aggregates: each group
(series x distribution x forecast style) reduces to a handful of sums, so
partial aggregation runs map-side and nothing is collected per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmaflow.functions.stats import t_two_sided_p

GROUP = ("series", "distribution", "forc_style")
FORECAST = "daily_variance_forecast"
SLOPE_TERM = "daily_variance_forecast"
INTERCEPT_TERM = "(Intercept)"


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def summary(perf: DataFrame, proxy: str, group: Sequence[str] = GROUP,
            forecast: str = FORECAST) -> DataFrame:
    """One aggregation pass per group: error moments and the OLS sums of ``proxy ~ 1 + forecast``.

    Rows where either side is null are skipped (as ``lm`` drops them); the
    skipped proxies are counted in ``n_missing``.
    """
    y, x = F.col(proxy), F.col(forecast)
    err = y - x
    s = perf.groupBy(*group).agg(
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(_div(F.abs(err), F.sqrt(y))).alias("mape"),
        F.count(err).cast("long").alias("n_obs"),
        F.count_if(y.isNull()).cast("long").alias("n_missing"),
        F.count_if((y == 0) & x.isNotNull()).cast("long").alias("n_zero_proxy"),
        F.regr_count(y, x).cast("long").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_avgx(y, x).alias("avgx"),
    )
    return _with_errors(s.withColumn("rmse", F.sqrt("mse")))


def error_metrics(perf: DataFrame, proxy: str, group: Sequence[str] = GROUP,
                  forecast: str = FORECAST) -> DataFrame:
    """mse, rmse, mae and mape (error over the square root of the proxy) per group.

    ``mape`` leaves out the ``n_zero_proxy`` days whose proxy is zero.
    """
    return summary(perf, proxy, group, forecast).select(
        *group, "mse", "rmse", "mae", "mape", "n_obs", "n_missing", "n_zero_proxy")


def _with_errors(s: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    sse = F.col("syy") - _div(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    sigma2 = _div(sse, n - 2)
    return (s.withColumn("sse", sse)
            .withColumn("sigma2", sigma2)
            .withColumn("se_slope", F.sqrt(_div(F.col("sigma2"), F.col("sxx"))))
            .withColumn("se_intercept",
                        F.sqrt(F.col("sigma2") * (_div(F.lit(1.0), n)
                                                  + _div(F.col("avgx") * F.col("avgx"), F.col("sxx")))))
            .withColumn("df_residual", (F.col("n") - 2).cast("long")))


def mz_tidy(perf: DataFrame, proxy: str, group: Sequence[str] = GROUP,
            forecast: str = FORECAST) -> DataFrame:
    """Per group and term: estimate, std_error, statistic, p_value (t with n-2 dof)."""
    return tidy_from_summary(summary(perf, proxy, group, forecast), group)


def tidy_from_summary(s: DataFrame, group: Sequence[str]) -> DataFrame:
    terms = F.array(
        F.struct(F.lit(INTERCEPT_TERM).alias("term"), F.col("intercept").alias("estimate"),
                 F.col("se_intercept").alias("std_error")),
        F.struct(F.lit(SLOPE_TERM).alias("term"), F.col("slope").alias("estimate"),
                 F.col("se_slope").alias("std_error")),
    )
    out = (s.select(*group, "df_residual", F.inline(terms))
           .withColumn("statistic", _div(F.col("estimate"), F.col("std_error"))))
    return (out.withColumn("p_value", t_two_sided_p("statistic", "df_residual"))
            .select(*group, "term", "estimate", "std_error", "statistic", "p_value"))


def mz_glance(perf: DataFrame, proxy: str, group: Sequence[str] = GROUP,
              forecast: str = FORECAST) -> DataFrame:
    """Per group: r_squared, adj_r_squared, sigma, F statistic, p_value, logLik, AIC, BIC..."""
    s = summary(perf, proxy, group, forecast)
    n = F.col("n").cast("double")
    loglik = -n / 2 * (F.lit(1.8378770664093453) + F.ln(_div(F.col("sse"), n)) + 1)  # ln(2*pi)
    t_slope = _div(F.col("slope"), F.col("se_slope"))
    return (
        s.withColumn("t_slope", t_slope)
        .withColumn("loglik", loglik)
        .select(
            *group,
            "r_squared",
            (1 - _div((1 - F.col("r_squared")) * (n - 1), n - 2)).alias("adj_r_squared"),
            F.sqrt("sigma2").alias("sigma"),
            (F.col("t_slope") * F.col("t_slope")).alias("statistic"),
            t_two_sided_p("t_slope", "df_residual").alias("p_value"),
            F.lit(1).cast("long").alias("df"),
            F.col("loglik").alias("loglik"),
            (-2 * F.col("loglik") + 6).alias("aic"),
            (-2 * F.col("loglik") + 3 * F.ln(n)).alias("bic"),
            F.col("sse").alias("deviance"),
            "df_residual",
            F.col("n").alias("nobs"),
        )
    )
