"""sigmaflow: volatility analytics for many price series at once, on Spark.

Every table carries a ``series`` key, so resampling, returns, windows,
model fits and evaluation all partition by series (and by day inside a
series) and scale out across a cluster.

Typical use::

    from sigmaflow import get_spark, ticks, resample_bars, log_returns, realized_variance
    spark = get_spark()
    rets = log_returns(resample_bars(ticks(spark, "/data/sf1")))
    rv = realized_variance(rets)
"""

__version__ = "0.1.0"

from sigmaflow.config import DAILY_PARAMS, TICK_PARAMS, GarchGrid, Params, ScaleKnobs  # noqa: E402,F401
from sigmaflow.operators.acf import acf  # noqa: E402,F401
from sigmaflow.operators.evaluate import error_metrics, mz_glance, mz_tidy  # noqa: E402,F401
from sigmaflow.operators.proxies import realized_variance, squared_daily_return  # noqa: E402,F401
from sigmaflow.operators.timeseries import (  # noqa: E402,F401
    collapse_to_daily,
    daily_close,
    daily_returns,
    exact_median,
    log_returns,
    replace_outliers,
    resample_bars,
)
from sigmaflow.operators.windows import rolling_windows  # noqa: E402,F401
from sigmaflow.session import get_spark, materialize  # noqa: E402,F401
from sigmaflow.sources.tables import daily_prices, ticks  # noqa: E402,F401
