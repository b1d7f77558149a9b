"""Shared inputs of the registered queries, built once per query plan.

``TickInputs`` memoises each intermediate DataFrame so that a query that uses
the returns in several branches references one logical subtree (Spark then
reuses the exchange) instead of re-deriving it per branch.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from sigmaflow.config import DEFAULT_KNOBS, TICK_PARAMS, Params, ScaleKnobs
from sigmaflow.operators import proxies as px
from sigmaflow.operators import timeseries as ts
from sigmaflow.session import materialize
from sigmaflow.sources.tables import daily_prices, ticks


def _keep(df: DataFrame, name: str, knobs: ScaleKnobs) -> DataFrame:
    return materialize(df, name) if knobs.materialize else df


class TickInputs:
    """Intraday pipeline on ``events``: ticks -> bars -> returns -> proxies."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = TICK_PARAMS,
                 knobs: ScaleKnobs = DEFAULT_KNOBS):
        self.spark, self.sf_dir, self.params, self.knobs = spark, sf_dir, params, knobs

    @cached_property
    def ticks(self) -> DataFrame:
        return ticks(self.spark, self.sf_dir)

    @cached_property
    def bar_summary(self) -> DataFrame:
        """First and last tick per bar: the only aggregation that reads the tick table.

        Written once, so bars, returns and daily closes never rescan the ticks.
        """
        return _keep(ts.bar_summary(self.ticks), "bar-summary", self.knobs)

    @cached_property
    def bars(self) -> DataFrame:
        return ts.bars_from_summary(self.bar_summary)

    @cached_property
    def returns_5min(self) -> DataFrame:
        return _keep(ts.log_returns(self.bars, bucket="day", tz=self.params.tz), "returns-5min", self.knobs)

    @cached_property
    def returns_5min_filtered(self) -> DataFrame:
        return _keep(ts.replace_outliers(self.returns_5min, knobs=self.knobs), "returns-5min-filtered", self.knobs)

    @cached_property
    def returns_daily(self) -> DataFrame:
        """Daily returns from the last tick of each day (from the same bar summary)."""
        closes = ts.daily_close_from_summary(self.bar_summary, self.params.tz)
        return _keep(ts.log_returns(closes, bucket="year", tz=self.params.tz), "returns-daily", self.knobs)

    @cached_property
    def rv_all(self) -> DataFrame:
        return px.realized_variance(self.returns_5min)

    @cached_property
    def rv_filtered_all(self) -> DataFrame:
        return px.realized_variance(self.returns_5min_filtered)

    @cached_property
    def rv(self) -> DataFrame:
        """Out-of-sample realized variance."""
        return ts.out_of_sample(self.rv_all, self.params)

    @cached_property
    def sq(self) -> DataFrame:
        """Out-of-sample squared daily return."""
        return px.squared_daily_return(self.returns_daily, self.params)


def tick_prices(spark: SparkSession, sf_dir: str, params: Params | None = None) -> DataFrame:
    return ticks(spark, sf_dir, params)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.resample_bars(tick_prices(spark, sf_dir))


def returns_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.log_returns(bars(spark, sf_dir), bucket="day")


def returns_daily_from_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.daily_returns(tick_prices(spark, sf_dir))


def returns_daily_orders(spark: SparkSession, sf_dir: str, knobs: ScaleKnobs = DEFAULT_KNOBS) -> DataFrame:
    """Long daily series (one price per day and order priority) for daily GARCH fits."""
    return _keep(ts.daily_returns(daily_prices(spark, sf_dir)), "returns-daily-orders", knobs)
