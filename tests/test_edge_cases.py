"""Degenerate series go through every operator without errors and with sane output."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sigmaflow.config import Params
from sigmaflow.operators import proxies as px
from sigmaflow.operators import timeseries as ts
from sigmaflow.operators.acf import acf
from sigmaflow.plans import garch_jobs as J

P = Params(start=dt.datetime(2024, 1, 1), end=dt.datetime(2024, 1, 10, 23, 59, 59),
           forecast_start=dt.datetime(2024, 1, 6, 23, 55), excluded_day=None)


def _ticks(spark):
    rows = []
    t0 = dt.datetime(2024, 1, 1)
    # 'one': a single tick
    rows.append(("one", t0 + dt.timedelta(hours=1), 10.0, 1))
    # 'early': ticks only before the forecast origin
    rows += [("early", t0 + dt.timedelta(minutes=7 * i), 10.0 + i % 3, 100 + i) for i in range(300)]
    # 'flat': constant price every 5 minutes for 10 days (all returns 0)
    rows += [("flat", t0 + dt.timedelta(minutes=5 * i), 50.0, 10_000 + i) for i in range(10 * 288)]
    # 'dup': two ticks at the same timestamp in every bar; the smaller tick_id must win
    rng = np.random.default_rng(2)
    for i in range(10 * 96):
        ts_ = t0 + dt.timedelta(minutes=15 * i)
        rows.append(("dup", ts_, float(100 + rng.normal()), 2 * i + 1))
        rows.append(("dup", ts_, 999.0, 2 * i + 2))
    return spark.createDataFrame(rows, "series string, date timestamp_ntz, adjusted double, tick_id long")


def test_degenerate_series(spark):
    ticks = _ticks(spark)
    bars = ts.resample_bars(ticks)
    assert bars.where("series = 'dup' AND adjusted = 999.0").count() == 0
    summary = ts.bar_summary(ticks)
    closes = ts.daily_close_from_summary(summary).toPandas()
    assert (closes[closes.series == "dup"]["adjusted"] == 999.0).all()  # last = larger tick_id
    rets = ts.log_returns(bars)
    counts = dict(rets.groupBy("series").count().collect())
    assert "one" not in counts and counts["flat"] == 10 * 288 - 1
    rv = px.realized_variance(rets, P).toPandas()
    assert set(rv.series) == {"flat", "dup"}
    assert (rv[rv.series == "flat"]["realized_variance"] == 0).all()
    med = dict(ts.exact_median(rets, "return").collect())
    assert med["flat"] == 0.0
    filt = ts.replace_outliers(rets).where("series = 'flat'").agg(F.max(F.abs("return"))).first()[0]
    assert filt == 0.0
    a = acf(rets.select("series", "date", "return"), "return", ["series"]).toPandas()
    # a constant series has no defined autocorrelation (0/0 -> null), others start at 1
    assert a[a.series == "flat"]["acf"].isna().all()
    assert np.isclose(a[(a.series == "dup") & (a.lag == 0)]["acf"].iloc[0], 1.0)
    fi = J.FitInputs(rets, P)
    win = fi.windows.toPandas()
    assert set(win.series) == {"flat", "dup"} and (win.groupby("series").size() == 4).all()
    fc = J.rolling_grid_forecast(spark, fi, "5min").toPandas()
    assert len(fc) == 2 * 4 * 2
    dup = fc[fc.series == "dup"]["daily_variance_forecast"]
    assert np.isfinite(dup).all() and (dup > 0).all()
