"""Registered queries on stand-in forecasts (lagged realized variance): proxies, metrics, regressions, tables.

They test the evaluation operators apart from the models; the same datasets on model
forecasts are the ``garch_*`` queries.
"""

from __future__ import annotations

from sigmaflow.config import TICK_PARAMS
from sigmaflow.operators import evaluate as ev
from sigmaflow.plans import evaluation as E
from sigmaflow.plans import inputs as inp
from sigmaflow.plans.registry import register

P = TICK_PARAMS
STYLES_MAIN = {"5min": "five_min", "daily": "daily", "5min_no_outlier": "five_min_no_outlier"}
STYLES_FILTERED = {"5min_filtered": "five_min_filtered"}


def proxies(spark, sf_dir, ctx=None):
    ctx = ctx or inp.TickInputs(spark, sf_dir)
    return ctx.rv, ctx.sq


def naive(spark, sf_dir, ctx=None):
    ctx = ctx or inp.TickInputs(spark, sf_dir)
    return E.naive_forecasts(ctx.rv_all, ctx.rv_filtered_all, P)


@register("naive_all_forecasts")
def all_forecasts(spark, sf_dir):
    return naive(spark, sf_dir)


@register("naive_performance_data")
def performance_data(spark, sf_dir):
    ctx = inp.TickInputs(spark, sf_dir)
    return E.performance_data(naive(spark, sf_dir, ctx), ctx.rv, ctx.sq, P)


@register("naive_performance_data_filtered")
def performance_data_filtered(spark, sf_dir):
    ctx = inp.TickInputs(spark, sf_dir)
    return E.performance_data_filtered(naive(spark, sf_dir, ctx), ctx.rv, ctx.sq)


@register("naive_compare_styles_long")
def compare_styles_long(spark, sf_dir):
    ctx = inp.TickInputs(spark, sf_dir)
    return E.compare_styles_long(naive(spark, sf_dir, ctx), ctx.rv)


@register("naive_compare_dists_long")
def compare_dists_long(spark, sf_dir):
    ctx = inp.TickInputs(spark, sf_dir)
    return E.compare_dists_long(naive(spark, sf_dir, ctx), ctx.rv)


@register("naive_compare_filtered_long")
def compare_filtered_long(spark, sf_dir):
    ctx = inp.TickInputs(spark, sf_dir)
    return E.compare_filtered_long(naive(spark, sf_dir, ctx), ctx.rv)


def _perf3(spark, sf_dir):
    ctx = inp.TickInputs(spark, sf_dir)
    return E.performance_data_filtered(naive(spark, sf_dir, ctx), ctx.rv, ctx.sq)


@register("naive_error_metrics_rv")
def error_metrics_rv(spark, sf_dir):
    return ev.error_metrics(_perf3(spark, sf_dir), "realized_variance")


@register("naive_error_metrics_sqret")
def error_metrics_sqret(spark, sf_dir):
    return ev.error_metrics(_perf3(spark, sf_dir), "squared_return")


@register("naive_mz_tidy_rv")
def mz_tidy_rv(spark, sf_dir):
    return ev.mz_tidy(_perf3(spark, sf_dir), "realized_variance")


@register("naive_mz_glance_rv")
def mz_glance_rv(spark, sf_dir):
    return ev.mz_glance(_perf3(spark, sf_dir), "realized_variance")


@register("naive_mz_tidy_sqret")
def mz_tidy_sqret(spark, sf_dir):
    return ev.mz_tidy(_perf3(spark, sf_dir), "squared_return")


@register("naive_mz_glance_sqret")
def mz_glance_sqret(spark, sf_dir):
    return ev.mz_glance(_perf3(spark, sf_dir), "squared_return")


@register("naive_result_table")
def result_table(spark, sf_dir):
    return E.result_table(performance_data.raw(spark, sf_dir), STYLES_MAIN)


@register("naive_result_table_filtered")
def result_table_filtered(spark, sf_dir):
    return E.result_table(_perf3(spark, sf_dir), STYLES_FILTERED)


@register("naive_result_table_display")
def result_table_display(spark, sf_dir):
    t = E.result_table(performance_data.raw(spark, sf_dir), STYLES_MAIN)
    return E.result_table_display(t)
