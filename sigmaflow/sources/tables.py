"""Adapters from the provided parquet tables to the library's price schema.

Every price table has the columns ``series string, date timestamp_ntz,
adjusted double, tick_id bigint`` (``tick_id`` breaks ties between rows
with the same timestamp). Filters are written on the raw columns so they
reach the parquet scan as pushed filters, and only the needed columns are
read.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmaflow.config import Params
from sigmaflow.functions.columns import ntz_lit


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _usable(price: str, date: str, params: Params | None) -> Column:
    """Prices that have a logarithm, and nulls (whose returns are null and stay); with ``params``,
    only the closed analysis range."""
    keep = F.col(price).isNull() | (F.col(price) > 0)
    return keep if params is None else keep & F.col(date).between(ntz_lit(params.utc(params.start)), ntz_lit(params.utc(params.end)))


def ticks(spark: SparkSession, sf_dir: str, params: Params | None = None) -> DataFrame:
    """Intraday prices from ``events``: one series per event type (P1 projection).

    All rows of the table but those with a zero price; ``params`` adds the closed range filter (P2).
    """
    ev = load(spark, sf_dir, "events")
    return (
        ev.where(_usable("value", "ts", params))
        .select(
            F.col("event_type").alias("series"),
            F.col("ts").alias("date"),
            F.col("value").alias("adjusted"),
            F.col("event_id").alias("tick_id"),
        )
    )


def daily_prices(spark: SparkSession, sf_dir: str, params: Params | None = None) -> DataFrame:
    """Prices stamped at midnight from ``orders``: one series per order priority.

    Several rows share a day; the daily close later picks the largest
    ``o_orderkey`` (``tick_id``) of the day.
    """
    od = load(spark, sf_dir, "orders")
    return (
        od.where(_usable("o_totalprice", "o_orderdate", params))
        .select(
            F.col("o_orderpriority").alias("series"),
            F.col("o_orderdate").alias("date"),
            F.col("o_totalprice").alias("adjusted"),
            F.col("o_orderkey").alias("tick_id"),
        )
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of intraday prices from ``orders``: the second of the day comes from the order key, naive UTC."""
    od = load(spark, sf_dir, "orders")
    return od.where(_usable("o_totalprice", "o_orderdate", None)).select(
        F.col("o_orderpriority").alias("series"),
        F.expr("timestampadd(SECOND, CAST(o_orderkey * 7919 % 86400 AS INT), CAST(o_orderdate AS TIMESTAMP_NTZ))").alias("date"),
        F.col("o_totalprice").alias("adjusted"),
        F.col("o_orderkey").alias("tick_id"))
