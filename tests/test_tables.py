"""Inferred scans and quarantine, zones with clock changes, nested tables, total order on disk, display by type."""

import datetime as dt
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigmaflow.config import Params
from sigmaflow.functions.columns import day_hours, day_ts
from sigmaflow.operators import nest as N
from sigmaflow.operators import timeseries as ts
from sigmaflow.operators import windows as W
from sigmaflow.plans.evaluation import result_table_display
from sigmaflow.session import scratch_path
from sigmaflow.sources import files
from sigmaflow.sources import scan as S


def written(tmp_path, *texts):
    os.makedirs(tmp_path / "csv")
    for i, t in enumerate(texts):
        (tmp_path / "csv" / f"f{i}.csv").write_text(t)
    return str(tmp_path / "csv")


GOOD = "series,Timestamp,Weighted_Price,note\n" + "".join(f"a,{1000 + i},{i}.5,2020-01-0{1 + i % 9} 10:00:00\n" for i in range(40))


def test_types_from_all_files_and_every_line_somewhere(spark, tmp_path):
    odd = ["b,x1,2.0,", "b,5", "b,5,6,2020-01-01,more", "b,99999999999999999999,1,", "b,7,Infinity,", "b, 8 , 9 ,NA", "c,,,2020-13-45 00:00:00", '"d,e",4,1e3,']
    path = written(tmp_path, GOOD, "Series,timestamp,weighted_price,NOTE\n" + "\n".join(odd) + "\n")
    found = S.infer(spark, path)
    assert found.types == ("string", "bigint", "double", "timestamp_ntz")
    good, bad = S.scan(spark, path, found, required=(found.names[2],))
    assert good.count() + bad.count() == 48
    rows = {(r[0], r[1], r[2], r[3]) for r in good.collect()}
    assert ("b", 8, 9.0, None) in rows and ("d,e", 4, 1000.0, None) in rows and ("a", 1000, 0.5, dt.datetime(2020, 1, 1, 10)) in rows
    ts_, price, note = found.names[1:]
    reasons = Counter(x for r in bad.collect() for x in r.reasons)
    assert reasons == {f"{ts_}: not a bigint": 2, "number of fields": 2, f"{price}: not a double": 1, f"{price}: missing": 1, f"{note}: not a timestamp_ntz": 1}
    assert {r.reason: r.n_lines for r in S.problems(bad).collect()} == dict(reasons)
    assert {r.line for r in bad.collect()} >= {"b,5", "b,5,6,2020-01-01,more", "c,,,2020-13-45 00:00:00"}
    assert {r.file for r in bad.collect()} == {"f1.csv"}


def test_a_price_column_of_text_is_text(spark, tmp_path):
    path = written(tmp_path, "a,b\n" + "x,1\ny,n/a\nz,w\n" * 10)
    assert S.infer(spark, path).types == ("string", "string")


def test_another_header_ends_the_scan(spark, tmp_path):
    path = written(tmp_path, GOOD, "series,Weighted_Price,Timestamp,note\na,1,2,\n")
    with pytest.raises(Exception, match="header|schema"):
        S.scan(spark, path)[0].collect()


def test_files_without_lines(spark, tmp_path):
    good, bad = S.scan(spark, written(tmp_path, "a,b\n"))
    assert good.isEmpty() and bad.isEmpty() and good.columns == ["a", "b"]


# ---------------------------------------------------------------- zones

BERLIN = Params(tz="Europe/Berlin", start=dt.datetime(2021, 1, 1), end=dt.datetime(2021, 12, 31), forecast_start=dt.datetime(2021, 3, 26, 23, 55), excluded_day=None)


@pytest.fixture(scope="module")
def half_hours(spark):
    """Gapless half hours over both clock changes of a year, in UTC."""
    n = 330 * 48
    return spark.range(n).select(F.lit("s").alias("series"), F.expr("timestampadd(MINUTE, CAST(id * 30 AS INT), TIMESTAMP_NTZ'2021-01-01 00:00:00')").alias("date"),
                                 (F.lit(100.0) + F.col("id") % 13).alias("adjusted"), F.col("id").alias("tick_id"))


def test_days_of_23_and_25_hours(spark, half_hours):
    rets = ts.log_returns(half_hours, tz=BERLIN.tz)
    days = {str(r.day.date()): r.n_rows for r in W.day_table(rets).collect()}
    assert days["2021-03-28"] == 46 and days["2021-10-31"] == 50 and days["2021-06-15"] == 48
    hours = {str(r.day.date()): r.h for r in rets.select("day", day_hours("day", BERLIN.tz).alias("h")).distinct().collect()}
    assert hours["2021-03-28"] == 23 and hours["2021-10-31"] == 25 and Counter(hours.values())[24.0] == len(hours) - 2
    win = {str(r.target_day.date()): r.n_ahead for r in W.rolling_windows(rets, BERLIN).collect()}
    assert win["2021-03-28"] == 46 and win["2021-10-31"] == 50 and "2021-03-26" not in win
    assert set(W.rolling_windows(ts.log_returns(half_hours), BERLIN).select("n_ahead").distinct().toPandas().n_ahead) == {48}


def test_origin_and_closes_follow_the_zone(spark, half_hours):
    rets = ts.log_returns(half_hours, tz=BERLIN.tz)
    assert ts.out_of_sample(rets, BERLIN, strict=True).agg(F.min("date")).first()[0] == dt.datetime(2021, 3, 26, 23, 0)  # 23:55 in winter is 22:55 UTC
    assert ts.out_of_sample(rets, BERLIN).agg(F.min("date")).first()[0] == dt.datetime(2021, 3, 26, 23, 0)
    closes = {r.day: r.date for r in ts.daily_close(half_hours, BERLIN.tz).collect()}
    assert closes[dt.datetime(2021, 3, 28)] == dt.datetime(2021, 3, 28, 21, 30) and closes[dt.datetime(2021, 10, 31)] == dt.datetime(2021, 10, 31, 22, 30)
    assert BERLIN.utc(dt.datetime(2021, 7, 1)) == dt.datetime(2021, 6, 30, 22) and Params().utc(dt.datetime(2021, 7, 1)) == dt.datetime(2021, 7, 1)


def test_same_days_under_any_session_zone(spark, half_hours):
    old = spark.conf.get("spark.sql.session.timeZone")
    want = half_hours.select(day_ts("date", BERLIN.tz).alias("d")).distinct().orderBy("d").collect()
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert half_hours.select(day_ts("date", BERLIN.tz).alias("d")).distinct().orderBy("d").collect() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# ---------------------------------------------------------------- nested tables


def test_chunks_are_bounded_and_rows_come_back(spark):
    rows = [("hot", i % 700, float(i % 5), None if i % 9 else "x") for i in range(5000)] + [("hot", 1, 1.0, "same")] * 900 + [(None, 1, 2.0, "n"), (None, None, None, None), ("b", 3, 4.0, "")]
    df = spark.createDataFrame(rows, "k string, a long, v double, t string")
    nested = N.nest(df, ["k"], 100)
    got = nested.collect()
    assert max(r.n for r in got) <= 100 and all(r.n == len(r.data) for r in got) and sum(r.n for r in got) == len(rows)
    assert len({(r.k, r.chunk) for r in got}) == len(got)
    back = Counter(tuple(r) for r in N.unnest(nested).select("k", "a", "v", "t").collect())
    assert back == Counter(rows)
    assert N.nest(df.limit(0), ["k"]).isEmpty() and N.unnest(N.nest(df.limit(0), ["k"])).isEmpty()


def test_line_per_group_is_the_aggregate(spark):
    rows = [(g, 1e6 + i, 3.0 * i + (i * 7919 % 11) + g) if i % 6 else (g, None, 1.0) for g in range(3) for i in range(400)] + [(9, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g long, x double, y double")
    got = {r.g: r for r in N.map_lm(N.nest(df, ["g"], 64), ["g"], "y", "x").collect()}
    want = df.groupBy("g").agg(F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_r2("y", "x").alias("r2"), F.regr_intercept("y", "x").alias("a")).collect()
    for w in want:
        r = got[w.g]
        assert r.nobs == w.n and (r.slope is None) == (w.b is None)
        if w.b is not None:
            assert abs(r.slope - w.b) < 1e-9 and abs(r.r_squared - w.r2) < 1e-9 and abs(r.intercept - w.a) < 1e-3


# ---------------------------------------------------------------- order and display


def test_files_hold_one_total_order(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 3).alias("part"))
    path = scratch_path(spark, "sorted")
    files.write_sorted(df, path, ["k"], 6)
    import pyarrow.parquet as pq
    names = sorted(n for n in os.listdir(path.replace("file:", "")) if n.endswith(".parquet"))
    assert len(names) >= 4
    keys = [k for n in names for k in pq.read_table(f"{path.replace('file:', '')}/{n}")["k"].to_pylist()]
    assert keys == sorted(keys) and len(keys) == 20_000
    back = files.read_sorted(spark, path).orderBy("position").collect()
    assert [r.k for r in back] == keys and [r.position for r in back] == list(range(1, 20_001))


def test_display_takes_every_fractional_column(spark):
    df = spark.createDataFrame([("a", "p", 1, "MAPE", 1.234567, 2), ("a", "p", 4, "MZ Slope Std. Error", None, 3)], "series string, proxy string, metric_rank long, metric string, one double, whole long")
    df = df.withColumn("two", F.col("metric_rank").cast("float"))
    got = result_table_display(df, 3).orderBy("metric_rank").collect()
    assert (got[0].one, got[0].two, got[0].metric) == ("1.235", "1.000", "MAPE") and (got[1].one, got[1].two, got[1].metric) == (None, "(4.000)", None)
    assert "whole" not in got[0].asDict()


def test_result_table_rows_come_in_the_printed_order(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    rows = E.queries()["naive_result_table"](spark, SF_SMALL).collect()
    keys = [(r.series, r.proxy, r.metric_rank) for r in rows]
    assert keys == sorted(keys) and len(keys) == len(set(keys))
