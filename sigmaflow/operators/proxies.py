"""Daily variance proxies: realized variance and squared daily return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmaflow.config import Params
from sigmaflow.functions.columns import floor_bar, recode
from sigmaflow.operators.timeseries import out_of_sample

# Display labels of the proxies.
PROXY_LABELS = {"realized_variance": "Realized Variance", "squared_return": "Squared Return"}


def realized_variance(returns_5min: DataFrame, params: Params | None = None) -> DataFrame:
    """Sum of squared intraday returns per series and day.

    ``date`` is the day's last intraday timestamp (the collapse-to-daily step).
    With ``params`` only out-of-sample days are kept. One partial + final hash
    aggregate on ``(series, day)``.
    """
    src = returns_5min if params is None else out_of_sample(returns_5min, params)
    return (src.groupBy("series", "day")
            .agg(F.max("date").alias("date"),
                 F.sum(F.col("return") * F.col("return")).alias("realized_variance")))


def squared_daily_return(daily_ret: DataFrame, params: Params | None = None) -> DataFrame:
    """Squared daily log return, stamped with the day's last timestamp floored to 5 minutes."""
    src = daily_ret if params is None else out_of_sample(daily_ret, params)
    return src.select("series", "day", floor_bar("date").alias("date"),
                      (F.col("return") * F.col("return")).alias("squared_return"))


def proxy_pair(rv: DataFrame, sq: DataFrame) -> DataFrame:
    """Realized variance left-joined with the squared return of the same day."""
    return rv.join(sq.select("series", "day", "squared_return"), ["series", "day"], "left")


def proxy_long(rv: DataFrame, sq: DataFrame) -> DataFrame:
    """Both proxies in long form, with display labels."""
    wide = proxy_pair(rv, sq)
    long = wide.unpivot(["series", "day", "date"], ["realized_variance", "squared_return"],
                        "proxy", "value")
    return long.withColumn("proxy", recode("proxy", PROXY_LABELS))


def proxy_noise(rv: DataFrame, sq: DataFrame) -> DataFrame:
    """Sample standard deviation of each proxy (squared returns are the noisier one)."""
    return (proxy_long(rv, sq).groupBy("series", "proxy")
            .agg(F.stddev_samp("value").alias("sd"), F.count("value").cast("long").alias("n_obs")))
