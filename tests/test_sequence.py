"""Bucketed order operators equal their whole-series window versions."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigmaflow.config import ScaleKnobs
from sigmaflow.operators import timeseries as ts
from sigmaflow.operators.acf import acf
from sigmaflow.operators.sequence import bucket_column, with_previous, with_row_index


def _prices(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2024-01-01")
    rows = []
    for s in ("a", "b"):
        t = start + pd.to_timedelta(np.sort(rng.integers(0, 6 * 86400, n)), unit="s")
        p = np.exp(np.cumsum(rng.normal(0, 0.01, n))) * 100
        rows += [(s, ti.to_pydatetime(), float(pi), i) for i, (ti, pi) in enumerate(zip(t, p))]
    return spark.createDataFrame(rows, "series string, date timestamp_ntz, adjusted double, tick_id long")


def test_with_previous_matches_global_lag(spark):
    df = _prices(spark).withColumn("_b", bucket_column("date", "day"))
    got = with_previous(df, "adjusted", "prev", ["series"], ["date", "tick_id"], "_b")
    w = Window.partitionBy("series").orderBy("date", "tick_id")
    want = df.select("series", "tick_id", F.lag("adjusted").over(w).alias("prev_w"),
                     (F.row_number().over(w) == 1).alias("first_w"))
    j = got.join(want, ["series", "tick_id"]).toPandas()
    assert len(j) == 800
    assert (j["_is_first"] == j["first_w"]).all()
    assert np.allclose(j["prev"].fillna(-1), j["prev_w"].fillna(-1))


def test_with_row_index_matches_row_number(spark):
    df = _prices(spark).withColumn("_b", bucket_column("date", "day"))
    got = with_row_index(df, "idx", ["series"], ["date", "tick_id"], "_b")
    w = Window.partitionBy("series").orderBy("date", "tick_id")
    j = got.withColumn("rn", F.row_number().over(w)).toPandas()
    assert (j["idx"] == j["rn"]).all()


def test_acf_chunking_is_exact(spark):
    df = ts.log_returns(_prices(spark)).select("series", "date", "return")
    a = acf(df, "return", ["series"]).toPandas().sort_values(["series", "lag"]).reset_index(drop=True)
    b = (acf(df, "return", ["series"], knobs=ScaleKnobs(chunk_rows=30)).toPandas()
         .sort_values(["series", "lag"]).reset_index(drop=True))
    assert len(a) == len(b) > 0
    assert np.allclose(a["acf"], b["acf"], atol=1e-12)
    # reference formula on one series
    x = df.where("series = 'a'").orderBy("date").toPandas()["return"].to_numpy()
    xc = x - x.mean()
    k = int(min(np.floor(10 * np.log10(len(x))), len(x) - 1))
    ref = [np.sum(xc[: len(x) - j] * xc[j:]) / np.sum(xc * xc) for j in range(k + 1)]
    assert np.allclose(a[a.series == "a"]["acf"].to_numpy(), ref, atol=1e-12)


def test_exact_median_with_ties_and_tight_sketch(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=2001), np.zeros(500), rng.normal(size=1000)])
    rows = [("a", float(v)) for v in vals] + [("b", float(v)) for v in vals[:1000]] + [("c", 1.0), ("c", 3.0)]
    df = spark.createDataFrame(rows, "series string, return double")
    for knobs in (ScaleKnobs(), ScaleKnobs(median_buckets=8, median_max_candidates=40)):
        got = ts.exact_median(df, "return", ("series",), knobs).toPandas()
        got = dict(zip(got.series, got["median"]))
        assert got["a"] == np.median(vals)
        assert got["b"] == np.median(vals[:1000])
        assert got["c"] == 2.0


def test_log_returns_null_and_repeated_price(spark):
    rows = [("s", f"2024-01-0{d} 12:00:00", p) for d, p in
            zip(range(1, 7), [10.0, 10.0, None, 12.0, 12.0, 11.0])]
    df = (spark.createDataFrame(rows, "series string, d string, adjusted double")
          .select("series", F.to_timestamp_ntz("d").alias("date"), "adjusted"))
    out = ts.log_returns(df, bucket="year").orderBy("date").toPandas()
    # only the first row is dropped; the null price voids two returns; a repeated price gives 0
    assert len(out) == 5
    r = out["return"].tolist()
    assert r[0] == 0.0 and pd.isna(r[1]) and pd.isna(r[2]) and r[3] == 0.0
    assert abs(r[4] - np.log(11 / 12)) < 1e-15
