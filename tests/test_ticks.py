"""Tied timestamps, hash aggregation, salted statistics, and the shared-folder rule."""

import datetime as dt
import types

import pytest

from sigmaflow import session
from sigmaflow.operators import timeseries as ts


def _prices(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 1)
    rows = [("a", t, 3.0, 9), ("a", t, 1.0, 2), ("a", t, 2.0, 5), ("a", t + dt.timedelta(seconds=7), 4.0, 1), ("a", t + dt.timedelta(seconds=7), 8.0, 3),
            ("b", t, None, 1), ("b", t + dt.timedelta(hours=30), 5.0, 4)]
    return spark.createDataFrame(rows, "series string, date timestamp_ntz, adjusted double, tick_id bigint")


def test_ties_go_by_tick_id(spark):
    p = _prices(spark)
    bars = {r.series: r for r in ts.resample_bars(p).orderBy("series", "bar").collect() if r.adjusted is not None}
    assert bars["a"].adjusted == 1.0 and bars["a"].date.second == 1
    close = [(r.series, r.adjusted) for r in ts.daily_close(p).orderBy("series", "day").collect()]
    assert close == [("a", 8.0), ("b", None), ("b", 5.0)]
    both = ts.bar_summary(p)
    assert sorted(map(tuple, ts.bars_from_summary(both).collect()), key=str) == sorted(map(tuple, ts.resample_bars(p).select("series", "bar", "date", "adjusted").collect()), key=str)
    assert sorted(map(tuple, ts.daily_close_from_summary(both).collect()), key=str) == sorted(map(tuple, ts.daily_close(p).collect()), key=str)


@pytest.mark.parametrize("build", [ts.bar_summary, ts.resample_bars, ts.daily_close])
def test_ticks_are_hash_aggregated(spark, build):
    plan = build(_prices(spark))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort " not in plan


def test_statistics_join_with_salts(spark, monkeypatch):
    df = spark.range(500).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS series", "id AS date", "CASE WHEN id = 7 THEN 1e6 WHEN id = 8 THEN NULL ELSE cast(id % 17 AS double) END AS return")
    want = sorted(map(str, ts.replace_outliers(df).collect()))
    monkeypatch.setattr(ts, "BROADCAST_ROWS", 0)
    assert sorted(map(str, ts.replace_outliers(df).collect())) == want


def test_cluster_without_shared_folder_is_an_error(monkeypatch):
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    monkeypatch.setattr(session, "_context", lambda spark: context)
    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
