"""Binned interval join against a plain loop: any ends, any bins, hot bins, odd slices."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sigmaflow.operators import slices as S

T0 = dt.datetime(1969, 12, 30)  # bins below zero too


def data(n=600, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), T0 + dt.timedelta(seconds=rng.randrange(6 * 86400), microseconds=rng.choice([0, 1, 999_999])), i, rng.choice([None, 1.0, -2.5])) for i in range(n)]
    rows += [("a", T0 + dt.timedelta(days=3, hours=1), 10_000 + i, 1.0) for i in range(400)]  # one hot second
    return [*rows, ("a", None, -1, 1.0)]


def cuts(seed=2):
    rng = random.Random(seed)
    out = [(rng.choice("abc"), i, T0 + dt.timedelta(seconds=(s := rng.randrange(6 * 86400))), T0 + dt.timedelta(seconds=s + rng.choice([0, 1, 500, 90_000, 300_000]))) for i in range(60)]
    edge = T0 + dt.timedelta(days=3)
    return [*out, ("a", 100, edge, edge + dt.timedelta(days=1)), ("a", 101, edge + dt.timedelta(days=1), edge), ("a", 102, None, edge), ("a", 103, edge, edge + dt.timedelta(hours=1)), ("b", 100, edge, edge)]


def tables(spark):
    rows = spark.createDataFrame(data(), "series string, date timestamp_ntz, id long, v double")
    return rows, spark.createDataFrame(cuts(), "series string, slice_id long, lo timestamp_ntz, hi timestamp_ntz")


def inside(cut, row):
    return row[1] is not None and cut[2] is not None and cut[0] == row[0] and cut[2] <= row[1] <= cut[3]


@pytest.mark.parametrize(("width", "hot"), [(86_400, 1_000_000), (3_600, 50), (700_000, 100), (86_400, 7)])
def test_slices_of_any_ends(spark, width, hot):
    rows, sl = tables(spark)
    got = sorted((r.series, r.slice_id, r.id) for r in S.slice_rows(rows, sl, width, hot).collect())
    assert got == sorted((c[0], c[1], r[2]) for c in cuts() for r in data() if inside(c, r))
    sums = {(r.series, r.slice_id): r for r in S.slice_sums(rows, sl, "v", width, hot).collect()}
    assert len(sums) == len(cuts())
    for c in cuts():
        mine = [r for r in data() if inside(c, r)]
        r, set_ = sums[c[0], c[1]], [x[3] for x in mine if x[3] is not None]
        assert (r.n_rows, r.n_null) == (len(mine), len(mine) - len(set_))
        assert (r.total is None) == (not set_) and abs((r.total or 0) - sum(set_)) < 1e-9 and abs((r.total_sq or 0) - sum(v * v for v in set_)) < 1e-9
        assert (r.first_date, r.last_date) == (min((x[1] for x in mine), default=None), max((x[1] for x in mine), default=None))


def test_repeated_slices_and_empty_tables(spark):
    rows, sl = tables(spark)
    twice = S.slice_rows(rows, sl.unionByName(sl)).count()
    assert twice == 2 * S.slice_rows(rows, sl).count()
    assert S.slice_rows(rows.limit(0), sl).isEmpty() and S.slice_rows(rows, sl.limit(0)).isEmpty() and S.slice_sums(rows, sl.limit(0), "v").isEmpty()
    assert {r.n_rows for r in S.slice_sums(rows.limit(0), sl, "v").collect()} == {0}


def test_plan_has_no_nested_loop(spark):
    rows, sl = tables(spark)
    for df in (S.slice_rows(rows, sl), S.slice_sums(rows, sl, "v")):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_hot_bin_is_dealt_over_tasks(spark):
    rows, _ = tables(spark)
    hot = S._hot_bins(rows.where("date IS NOT NULL").withColumn("_bin", S.bin_of("date")), 50).agg(F.max("_salts")).first()[0]
    assert hot >= 8
