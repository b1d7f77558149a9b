"""Affine prefix scan against a plain loop, saved states, resumed forecasts, the versioned store."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaflow.config import Params
from sigmaflow.operators import variance_path as V
from sigmaflow.plans import model_jobs as M
from sigmaflow.session import scratch_path
from sigmaflow.sources.model_store import ModelStore, NoVersion

PARAMS = Params(forecast_start=dt.datetime(2020, 1, 20, 23, 55), excluded_day=None)
MODELS = [("a", "Normal", 0.1, 0.85), ("a", "Student-t", 0.0, 0.999), ("b", "Normal", 0.3, 0.0), ("b", "Student-t", 0.05, 0.949)]


def data(nulls=False):
    rng = np.random.default_rng(3)
    rows = []
    for series, days, per_day in (("a", 30, 13), ("b", 150, 1)):
        for d in range(days):
            if d % 7 != 5:
                rows += [(series, dt.datetime(2020, 1, 1) + dt.timedelta(days=d, minutes=5 * i), None if nulls and (d, i) == (4, 0) else float(rng.normal())) for i in range(per_day)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "series string, date timestamp_ntz, return double").withColumn("day", F.to_date("date").cast("timestamp_ntz"))


def models(spark, h_first=1.5):
    return spark.createDataFrame([(*m, h_first) for m in MODELS], "series string, distribution string, alpha double, beta double, h_first double")


def plain(rows, h_first=1.5):
    out = {}
    for series, dist, a, b in MODELS:
        h = h_first
        for s, d, r in sorted((x for x in rows if x[0] == series), key=lambda x: x[1]):
            out[s, dist, d] = h
            h = None if h is None or r is None else a * r * r + b * h
    return out


@pytest.mark.parametrize("chunk", [2, 5, 64])
@pytest.mark.parametrize("nulls", [False, True])
def test_path_is_the_recursion(spark, chunk, nulls):
    rows = data(nulls)
    got = V.variance_path(table(spark, rows).repartition(7), models(spark), chunk=chunk).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for x in got:
        h = want[x.series, x.distribution, x.date]
        assert (x.h is None) == (h is None)
        if h is not None:
            assert np.isclose(x.h, h, rtol=1e-12) and np.isclose(x.sigma, np.sqrt(h))


def test_no_series_in_one_task(spark):
    text = V.variance_path(table(spark, data()), models(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in text  # only the one-row-per-day numbering
    assert "NestedLoop" not in text and "Cartesian" not in text


def fits(spark):
    rows = [(*m[:2], m[2], m[2] + m[3], m[3], 5.0 if m[1] != "Normal" else None, -1.0, 10, 9.9) for m in MODELS]
    return spark.createDataFrame(rows, "series string, distribution string, alpha double, persistence double, beta double, nu double, loglik double, n_obs long, h_next double")


def test_states_resume_where_the_path_goes_on(spark):
    rows = data()
    returns = table(spark, rows)
    store = M.save_states(spark, scratch_path(spark, "test-store"), fits(spark), returns, PARAMS)
    saved = store.read()
    path = {(p.series, p.distribution, p.date): p.h for p in M.fitted_path(fits(spark), returns, PARAMS).collect()}
    for s in saved.collect():
        assert s.last_date <= dt.datetime(2020, 1, 21) and np.isclose(s.h_last, path[s.series, s.distribution, s.last_date])
    first = {}
    for s, d, _ in rows:
        day = dt.datetime(d.year, d.month, d.day)
        first[s, day] = min(first.get((s, day), d), d)
    got = M.resumed_forecasts(saved, returns).collect()
    assert len(got) == 2 * len([k for k in first if k[1] > dt.datetime(2020, 1, 20)])
    for f in got:
        h = path[f.series, f.distribution, first[f.series, f.day]]
        p = next(m[2] + m[3] for m in MODELS if m[:2] == (f.series, f.distribution))
        assert np.isclose(f.h_start, h) and np.isclose(f.daily_variance_forecast, sum(h * p**k for k in range(f.n_ahead)))
    # carried on in two steps or one, the state is the same
    middle = table(spark, [r for r in rows if r[1] < dt.datetime(2020, 2, 10)])
    steps = M.advanced(M.advanced(saved, middle), returns).collect()
    once = {(s.series, s.distribution): s for s in M.advanced(saved, returns).collect()}
    for s in steps:
        assert np.isclose(s.h_next, once[s.series, s.distribution].h_next) and s.last_date == once[s.series, s.distribution].last_date
    assert sorted(map(str, M.advanced(saved, returns.limit(0)).collect())) == sorted(map(str, saved.drop("part").collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "series string, distribution string, h double")


def rows_of(df):
    return sorted(tuple(r)[:3] for r in df.select("series", "distribution", "h").collect())


def test_store_versions_and_replacement(spark):
    store = ModelStore(spark, scratch_path(spark, "test-store"))
    with pytest.raises(NoVersion):
        store.read()
    assert store.save(frame(spark, [("a", "N", 1.0), ("a", "T", 2.0), ("b", "N", 3.0)])) == 1
    assert store.save(frame(spark, [("a", "N", 9.0), ("c", "N", 4.0)])) == 2
    assert rows_of(store.read()) == [("a", "N", 9.0), ("b", "N", 3.0), ("c", "N", 4.0)]  # a's rows are replaced as a whole
    assert rows_of(store.read(1)) == [("a", "N", 1.0), ("a", "T", 2.0), ("b", "N", 3.0)]
    assert store.save(frame(spark, [])) == 3 and store.versions() == [1, 2, 3]
    before = rows_of(store.read())
    assert store.compact() == 4 and rows_of(store.read()) == before and {r.part for r in store.read().collect()} == {1}
    assert store.vacuum() == 3 and rows_of(store.read()) == before and store.versions() == [4]
    with pytest.raises(NoVersion):
        store.read(1)


def test_killed_writes_leave_the_last_version(spark):
    store = ModelStore(spark, scratch_path(spark, "test-store"))
    store.save(frame(spark, [("a", "N", 1.0)]))
    store._write(frame(spark, [("a", "N", 2.0)]))  # killed before its marker
    assert rows_of(store.read()) == [("a", "N", 1.0)]
    fs, path = store._fs(store._marker(2))
    fs.create(path, False).close()  # killed between making the marker and writing it
    fs, path = store._fs(store._marker(3))
    out = fs.create(path, False)
    out.write(bytearray(b'{"version": 3, "par'))
    out.close()
    assert store.versions() == [1] and rows_of(store.read()) == [("a", "N", 1.0)]
    assert store.save(frame(spark, [("b", "N", 5.0)])) == 4
    assert rows_of(store.read()) == [("a", "N", 1.0), ("b", "N", 5.0)]


def test_two_writers_keep_both(spark):
    root = scratch_path(spark, "test-store")
    one, two = ModelStore(spark, root), ModelStore(spark, root)
    part_one, part_two = one._write(frame(spark, [("a", "N", 1.0)])), two._write(frame(spark, [("b", "N", 2.0)]))
    raced = []

    def late(before):
        if not raced:  # the other writer takes this number's successor while the first still decides
            raced.append(two._commit(lambda b: [*b, part_two]))
        return [*before, part_one]

    one._commit(late)
    assert len(raced) == 1 and {("b", "N", 2.0)} <= set(rows_of(two.read(raced[0])))


def test_many_saves_are_compacted(spark, monkeypatch):
    from sigmaflow.sources import model_store
    monkeypatch.setattr(model_store, "MOST_PARTS", 3)
    store = ModelStore(spark, scratch_path(spark, "test-store"))
    for i in range(4):
        store.save(frame(spark, [(f"s{i % 3}", "N", float(i))]))
    assert rows_of(store.read()) == [("s0", "N", 3.0), ("s1", "N", 1.0), ("s2", "N", 2.0)]
    assert len(store._read_marker(store.versions()[-1])) <= 3
