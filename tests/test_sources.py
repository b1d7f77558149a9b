"""Source and sink contracts: raw CSV layout, partitioned parquet with pruning."""

import os

from pyspark.sql import functions as F

from sigmaflow.session import scratch_path
from sigmaflow.sources import files
from sigmaflow.sources.tables import ticks
from tests.conftest import SF_SMALL


def test_raw_csv_layout_and_round_trip(spark):
    t = ticks(spark, SF_SMALL)
    path = scratch_path(spark, "test-raw-csv")
    files.write_raw_prices_csv(t, path)
    raw = spark.read.option("header", True).csv(path)
    assert raw.columns == ["series", "Timestamp", "Weighted_Price"]
    assert raw.where(~F.col("Timestamp").rlike("^[0-9]+$")).count() == 0
    back = files.read_raw_prices_csv(spark, path)
    assert back.columns == ["series", "date", "adjusted"]
    assert back.count() == t.count()
    # whole seconds: the round trip truncates sub-second parts only
    diff = (back.join(t.select("series", F.date_trunc("second", "date").cast("timestamp_ntz").alias("date"),
                               "adjusted"), ["series", "date", "adjusted"], "left_anti").count())
    assert diff == 0


def test_parquet_sink_is_partitioned_and_pruned(spark):
    t = ticks(spark, SF_SMALL).select("series", "date", "adjusted")
    path = scratch_path(spark, "test-parquet")
    files.write_table(t, path, ("series",))
    local = path.split(":", 1)[1] if path.startswith("file:") else path
    assert sorted(d for d in os.listdir(local) if d.startswith("series=")) == sorted(
        f"series={r[0]}" for r in t.select("series").distinct().collect())
    q = files.read_table(spark, path).where(F.col("series") == "click")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(series" in plan and "click" in plan
    assert q.count() == t.where(F.col("series") == "click").count()
