"""Registered queries: inferred scans, zones, nested tables, total order on disk."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sigmaflow.config import Params
from sigmaflow.functions.columns import day_hours, epoch_to_ts, ts_to_epoch
from sigmaflow.operators import nest as N
from sigmaflow.operators import proxies as px
from sigmaflow.operators import timeseries as ts
from sigmaflow.operators import windows as W
from sigmaflow.plans import evaluation as E
from sigmaflow.plans import inputs as inp
from sigmaflow.plans.registry import register
from sigmaflow.session import materialize, scratch_path
from sigmaflow.sources import files
from sigmaflow.sources import scan as S
from sigmaflow.sources.tables import order_ticks

# Parameters of the order ticks, in a zone with daylight saving time.
ZONE_PARAMS = Params(tz="America/New_York", start=dt.datetime(1995, 1, 1), end=dt.datetime(2001, 8, 1, 23, 59, 59),
                     forecast_start=dt.datetime(2001, 3, 30, 23, 55), excluded_day=None)
HOURLY = "1 hour"


def _raw_lines(spark, sf_dir):
    """Prices as raw CSV lines, of which some are broken by a rule on the tick's number; the folder."""
    t = inp.tick_prices(spark, sf_dir).select("series", ts_to_epoch("date").alias("e"), F.col("adjusted").cast("string").alias("p"), (F.col("tick_id") % 97).alias("k"))
    at = F.when(F.col("k").isin(2, 6), "yesterday").otherwise(F.col("e").cast("string"))
    price = F.when(F.col("k").isin(1, 6), "n/a").when(F.col("k") == 5, "").otherwise(F.coalesce("p", F.lit("NaN")))
    line = (F.when(F.col("k") == 3, F.concat_ws(",", "series", at, price, F.lit("x"))).when(F.col("k") == 4, F.concat_ws(",", "series", at))
            .otherwise(F.concat_ws(",", "series", at, price)))
    path = scratch_path(spark, "raw-lines")
    t.select(F.col("series"), line.alias("line")).select("line").withColumnRenamed("line", "series,Timestamp,Weighted_Price").write.option("header", True).option("quote", "").csv(path, sep="\u0001")
    return path


@register("scan_inferred_prices")
def scan_inferred_prices(spark, sf_dir):
    """Prices of a raw CSV whose types are inferred; lines that don't fit are left out."""
    good, _ = S.scan(spark, _raw_lines(spark, sf_dir), required=("Weighted_Price",))
    return good.select("series", epoch_to_ts("Timestamp").alias("date"), F.col("Weighted_Price").alias("adjusted"))


@register("scan_quarantine")
def scan_quarantine(spark, sf_dir):
    """Lines of that file that don't fit, counted by reason."""
    _, bad = S.scan(spark, _raw_lines(spark, sf_dir), required=("Weighted_Price",))
    return S.problems(bad)


def _zone_returns(spark, sf_dir):
    bars = ts.resample_bars(order_ticks(spark, sf_dir), HOURLY)
    return materialize(ts.log_returns(bars, bucket="day", tz=ZONE_PARAMS.tz), "zone-returns")


@register("zone_realized_variance")
def zone_realized_variance(spark, sf_dir):
    """Realized variance of hourly returns by the calendar days of a zone, with the hours that each day has."""
    rv = px.realized_variance(_zone_returns(spark, sf_dir))
    return rv.select("series", "day", "date", "realized_variance", day_hours("day", ZONE_PARAMS.tz).alias("hours"))


@register("zone_daily_close")
def zone_daily_close(spark, sf_dir):
    """Last order tick of every calendar day of the zone."""
    return ts.daily_close(order_ticks(spark, sf_dir), ZONE_PARAMS.tz)


@register("zone_forecast_horizon")
def zone_forecast_horizon(spark, sf_dir):
    """Rolling windows on the zone's days: rows of the fit and of the day ahead."""
    w = W.rolling_windows(_zone_returns(spark, sf_dir), ZONE_PARAMS)
    return w.select("series", "window_id", "target_day", "lo", "hi", "n_fit", "n_ahead")


def _performance(spark, sf_dir):
    ctx = inp.TickInputs(spark, sf_dir)
    fc = E.naive_forecasts(ctx.rv_all, ctx.rv_filtered_all, ctx.params)
    return E.performance_data_filtered(fc, ctx.rv, ctx.sq)


@register("nested_mz")
def nested_mz(spark, sf_dir):
    """The Mincer-Zarnowitz line of each group of a nested table."""
    perf = _performance(spark, sf_dir)
    by = ["series", "distribution", "forc_style"]
    return N.map_lm(materialize(N.nest(perf, by), "nested"), by, "realized_variance", "daily_variance_forecast")


@register("nested_roundtrip")
def nested_roundtrip(spark, sf_dir):
    """5-minute returns nested by series in chunks of 500 rows, written, and unnested."""
    nested = materialize(N.nest(inp.returns_5min(spark, sf_dir).select("series", "date", "adjusted", "return"), ["series"], 500), "nested-returns")
    return N.unnest(nested)


@register("sorted_files_order")
def sorted_files_order(spark, sf_dir):
    """5-minute returns written in the total order of time and series; every row's place on disk."""
    path = scratch_path(spark, "sorted-returns")
    files.write_sorted(inp.returns_5min(spark, sf_dir).select("series", "date", "return"), path, ["date", "series"])
    return files.read_sorted(spark, path)
