"""Sample autocorrelation function per series, without a whole series in one task.

r_k = sum_{t=1}^{n-k} (x_t - m)(x_{t+k} - m) / sum_t (x_t - m)^2, k = 0..K with
K = min(floor(10 log10 n), n - 1) (the default lag count of ``acf``), plus the
+-1.96/sqrt(n) band.

Plan: a 1-based row index per series (bucketed by day), then rows are cut into
chunks of ``chunk_rows`` rows; the first K rows of a chunk are copied to the end of
the one before as a halo. A chunk is gathered once and all its lagged products are
formed in one vectorised pass; the sums are added per part. One shuffle of the rows (plus
the halo), no self-join, no window per lag.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigmaflow.config import ACF_BAND_Z, DEFAULT_KNOBS, ScaleKnobs
from sigmaflow.operators.sequence import bucket_column, with_row_index
from sigmaflow.operators.timeseries import spread_join
from sigmaflow.session import materialize


def default_max_lag(n):
    """Column expression for min(floor(10 * log10(n)), n - 1)."""
    return F.least(F.floor(10 * F.log10(n.cast("double"))), n - 1).cast("long")


def _lagged_sums(part: list[str]):
    schema = pa.schema([*((p, pa.string()) for p in part), ("lag", pa.int64()), ("c", pa.float64())])

    def run(chunk: pa.Table) -> pa.Table:
        order = np.argsort(chunk["_idx"].to_numpy(), kind="stable")
        x, own = chunk["_xc"].to_numpy()[order], int(np.sum(chunk["_mine"].to_numpy(zero_copy_only=False)))
        lags = np.arange(int(chunk["_K"][0].as_py()) + 1)
        sums = [float(np.dot(x[: max(0, min(own, len(x) - k))], x[k : k + max(0, min(own, len(x) - k))])) for k in lags]
        names = [pa.array([chunk[p][0].as_py()] * len(lags), pa.string()) for p in part]
        return pa.Table.from_arrays([*names, pa.array(lags), pa.array(sums)], schema=schema)

    return run


def acf(df: DataFrame, value_col: str, part: Sequence[str], order: str = "date",
        knobs: ScaleKnobs = DEFAULT_KNOBS) -> DataFrame:
    """Autocorrelations ``(part..., lag, acf, n, ci)`` of ``value_col`` ordered by ``order``; parts are strings."""
    part = list(part)
    x = df.where(F.col(value_col).isNotNull()).select(*part, order, F.col(value_col).alias("_x"))
    stats = materialize(x.groupBy(*part).agg(F.count("_x").alias("n"), F.avg("_x").alias("_mean"))
                        .withColumn("_K", default_max_lag(F.col("n"))), "acf-parts")
    idx = with_row_index(x.withColumn("_bucket", bucket_column(order, "day")), "_idx", part, [order],
                         "_bucket").drop("_bucket")
    chunk = F.greatest(F.lit(int(knobs.chunk_rows)), F.col("_K") + 1)
    centred = (spread_join(idx, stats, part)
               .select(*part, "_idx", "_K", (F.col("_x") - F.col("_mean")).alias("_xc"),
                       F.floor((F.col("_idx") - 1) / chunk).alias("_own"), ((F.col("_idx") - 1) % chunk).alias("_at")))
    halo = (F.col("_at") < F.col("_K")) & (F.col("_own") > 0)
    copies = centred.withColumn("_chunk", F.explode(F.when(halo, F.array("_own", F.col("_own") - 1)).otherwise(F.array("_own"))))
    copies = copies.withColumn("_mine", F.col("_chunk") == F.col("_own")).drop("_own", "_at")
    sums = copies.groupBy(*part, "_chunk").applyInArrow(_lagged_sums(part), ", ".join(f"{p} string" for p in part) + ", lag bigint, c double")
    total = sums.groupBy(*part, "lag").agg(F.sum("c").alias("_ck"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("_ck"))).over(Window.partitionBy(*part))
    return (total.withColumn("_c0", zero).join(stats, part, "inner")
            .select(*part, "lag", F.try_divide(F.col("_ck"), F.col("_c0")).alias("acf"),
                    F.col("n").cast("long").alias("n"),
                    (F.lit(ACF_BAND_Z) / F.sqrt(F.col("n").cast("double"))).alias("ci")))


TRANSFORMS = ("returns", "squared", "absolute")


def transformed(returns: DataFrame, transform: str) -> DataFrame:
    r = F.col("return")
    expr = {"returns": r, "squared": r * r, "absolute": F.abs(r)}[transform]
    return returns.select("series", "date", expr.alias("value"))


def acf_panels(returns_by_sampling: dict[str, DataFrame], transform: str,
               knobs: ScaleKnobs = DEFAULT_KNOBS) -> DataFrame:
    """ACF of one transform of the returns for each sampling (e.g. '5min', 'daily')."""
    parts = [transformed(df, transform).withColumn("sampling", F.lit(name))
             for name, df in returns_by_sampling.items()]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    out = acf(stacked, "value", ["series", "sampling"], "date", knobs)
    return out.withColumn("transform", F.lit(transform)).select(
        "series", "sampling", "transform", "lag", "acf", "n", "ci")
