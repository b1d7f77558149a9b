"""Registered queries: sources, cleaning, resampling, returns, proxies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmaflow.config import TICK_PARAMS
from sigmaflow.operators import proxies as px
from sigmaflow.operators import timeseries as ts
from sigmaflow.plans import inputs as inp
from sigmaflow.plans.registry import register
from sigmaflow.session import scratch_path
from sigmaflow.sources import files


@register("clean_prices")
def clean_prices(spark, sf_dir):
    """Projected, range-filtered tick prices."""
    return inp.tick_prices(spark, sf_dir, TICK_PARAMS).select("series", "date", "adjusted")


@register("scan_csv_roundtrip")
def scan_csv_roundtrip(spark, sf_dir):
    """Write prices in the raw CSV layout, read them back with a fixed schema."""
    path = scratch_path(spark, "raw-prices-csv")
    files.write_raw_prices_csv(inp.tick_prices(spark, sf_dir), path)  # the reader applies the range
    return files.read_raw_prices_csv(spark, path, TICK_PARAMS)


@register("scan_parquet_roundtrip")
def scan_parquet_roundtrip(spark, sf_dir):
    """Write 5-minute bars as parquet partitioned by series, read them back."""
    path = scratch_path(spark, "bars-parquet")
    files.write_table(inp.bars(spark, sf_dir), path, ("series",))
    return files.read_table(spark, path).select("series", "bar", "date", "adjusted")


@register("resample_5min")
def resample_5min(spark, sf_dir):
    return inp.bars(spark, sf_dir)


@register("daily_close")
def daily_close(spark, sf_dir):
    """Last 5-minute bar of every day."""
    return ts.daily_close(inp.bars(spark, sf_dir))


@register("log_returns_5min")
def log_returns_5min(spark, sf_dir):
    return inp.returns_5min(spark, sf_dir).select("series", "bar", "day", "date", "adjusted", "return")


@register("log_returns_daily")
def log_returns_daily(spark, sf_dir):
    """Daily log returns from the last tick of each day."""
    return inp.returns_daily_from_ticks(spark, sf_dir).select("series", "day", "date", "adjusted", "return")


@register("log_returns_daily_orders")
def log_returns_daily_orders(spark, sf_dir):
    """Daily log returns of the order-price series (largest order key per day)."""
    return inp.returns_daily_orders(spark, sf_dir).select("series", "day", "date", "adjusted", "return")


@register("collapse_to_daily")
def collapse_to_daily(spark, sf_dir):
    return ts.collapse_to_daily(inp.returns_5min(spark, sf_dir)).select("series", "bar", "date", "return")


@register("floor_5min")
def floor_5min(spark, sf_dir):
    from sigmaflow.functions.columns import floor_bar
    d = inp.returns_daily_from_ticks(spark, sf_dir)
    return d.select("series", "day", floor_bar("date").alias("date"), "return")


@register("outlier_stats")
def outlier_stats(spark, sf_dir):
    return ts.outlier_stats(inp.TickInputs(spark, sf_dir).returns_5min)


@register("outlier_replace")
def outlier_replace(spark, sf_dir):
    return ts.replace_outliers(inp.TickInputs(spark, sf_dir).returns_5min).select("series", "date", "return")


@register("oos_count")
def oos_count(spark, sf_dir):
    return ts.oos_count(inp.returns_5min(spark, sf_dir), TICK_PARAMS)


@register("oos_strict")
def oos_strict(spark, sf_dir):
    """Returns after the exact forecast origin (``date > forecast_start``), next to the day rule."""
    r = inp.returns_5min(spark, sf_dir)
    return ts.out_of_sample(r, TICK_PARAMS, strict=True).select("series", "day", "date", "return")


@register("scan_cleaned_csv_roundtrip")
def scan_cleaned_csv_roundtrip(spark, sf_dir):
    """Write cleaned prices as ``date, adjusted`` (microseconds kept) and read them back."""
    path = scratch_path(spark, "cleaned-prices-csv")
    files.write_cleaned_prices_csv(inp.tick_prices(spark, sf_dir), path)
    return files.read_cleaned_prices_csv(spark, path)


@register("realized_variance")
def realized_variance(spark, sf_dir):
    """Flagship: daily realized variance of 5-minute returns, out-of-sample days."""
    return px.realized_variance(inp.returns_5min(spark, sf_dir), TICK_PARAMS)


@register("squared_daily_return")
def squared_daily_return(spark, sf_dir):
    return px.squared_daily_return(inp.returns_daily_from_ticks(spark, sf_dir), TICK_PARAMS)


def _proxies(spark, sf_dir):
    ctx = inp.TickInputs(spark, sf_dir)
    return ctx.rv, ctx.sq


@register("proxy_compare")
def proxy_compare(spark, sf_dir):
    return px.proxy_long(*_proxies(spark, sf_dir))


@register("proxy_noise")
def proxy_noise(spark, sf_dir):
    return px.proxy_noise(*_proxies(spark, sf_dir))


@register("returns_union")
def returns_union(spark, sf_dir):
    """Return-series figure data: 5-minute and daily (last bar) returns with r^2 and |r|."""
    ctx = inp.TickInputs(spark, sf_dir)
    five = ctx.returns_5min.select("series", "date", "adjusted", "return")
    dly = ts.log_returns(ts.daily_close(ctx.bars), bucket="year")
    both = (five.withColumn("type", F.lit("5 Minute"))
            .unionByName(dly.select("series", "date", "adjusted", "return")
                         .withColumn("type", F.lit("Daily")), allowMissingColumns=True))
    return both.select("series", "type", "date", "adjusted", "return",
                       (F.col("return") * F.col("return")).alias("squared_return"),
                       F.abs("return").alias("abs_return"))


def _acf(spark, sf_dir, transform, knobs=None):
    from sigmaflow.config import DEFAULT_KNOBS
    from sigmaflow.operators.acf import acf_panels
    ctx = inp.TickInputs(spark, sf_dir)
    daily = ts.log_returns(ts.daily_close(ctx.bars), bucket="year")
    return acf_panels({"5min": ctx.returns_5min, "daily": daily}, transform, knobs or DEFAULT_KNOBS)


@register("acf_returns")
def acf_returns(spark, sf_dir):
    return _acf(spark, sf_dir, "returns")


@register("acf_squared")
def acf_squared(spark, sf_dir):
    return _acf(spark, sf_dir, "squared")


@register("acf_absolute")
def acf_absolute(spark, sf_dir):
    return _acf(spark, sf_dir, "absolute")
