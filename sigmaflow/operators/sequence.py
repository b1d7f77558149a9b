"""Order-dependent operators that never put a whole series into one task.

A single series may hold a third of all rows, so ``Window.partitionBy('series')``
over raw rows is not allowed. Instead a series is cut into buckets (calendar
days by default): row-level windows run per ``(series, bucket)``, and the state
that crosses a bucket boundary (the previous bucket's last value, or the number
of rows before the bucket) is computed on the one-row-per-bucket summary table,
whose size is bounded by the calendar rather than by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_column(date_col: str = "date", unit: str = "day") -> Column:
    """Calendar bucket of a naive timestamp: 'day', 'month' or 'year' (a date)."""
    d = F.to_date(F.col(date_col))
    if unit == "day":
        return d
    return F.trunc(d, unit)


def with_previous(
    df: DataFrame,
    value_col: str,
    out_col: str,
    part: Sequence[str] = ("series",),
    order: Sequence[str] = ("date",),
    bucket_col: str = "_bucket",
    first_col: str = "_is_first",
) -> DataFrame:
    """Add ``out_col`` = ``lag(value_col)`` over ``part`` ordered by ``order``.

    ``bucket_col`` must be monotone in ``order`` within a part. Also adds the
    boolean ``first_col`` that marks the first row of each part.
    """
    part, order = list(part), list(order)
    keys = part + [bucket_col]
    w_in = Window.partitionBy(*keys).orderBy(*order)
    w_bucket = Window.partitionBy(*part).orderBy(bucket_col)
    order_key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    # row-level lag inside each bucket: one exchange on (part, bucket)
    rows = (df.withColumn("_rn", F.row_number().over(w_in))
            .withColumn("_lag", F.lag(value_col).over(w_in)))
    # one row per bucket from the same partitioning (no new exchange), then the
    # previous bucket's last value over the small per-bucket table
    ends = (
        rows.groupBy(*keys)
        .agg(F.max_by(F.col(value_col), order_key).alias("_last"))
        .select(*keys,
                F.lag("_last").over(w_bucket).alias("_carry"),
                F.lag(bucket_col).over(w_bucket).isNotNull().alias("_has_prev"))
    )
    first_in_bucket = F.col("_rn") == 1
    return (
        rows.join(ends, keys, "inner")
        .withColumn(out_col, F.when(first_in_bucket, F.col("_carry")).otherwise(F.col("_lag")))
        .withColumn(first_col, first_in_bucket & ~F.col("_has_prev"))
        .drop("_rn", "_lag", "_carry", "_has_prev")
    )


def with_row_index(
    df: DataFrame,
    idx_col: str,
    part: Sequence[str] = ("series",),
    order: Sequence[str] = ("date",),
    bucket_col: str = "_bucket",
) -> DataFrame:
    """Add a 1-based row number over ``part`` ordered by ``order``, computed per bucket.

    Row numbers inside a bucket come from a bucket-local window; the offset of
    each bucket is a running sum over the per-bucket counts.
    """
    part, order = list(part), list(order)
    keys = part + [bucket_col]
    before = Window.partitionBy(*part).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
               .select(*keys, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off")))
    w_in = Window.partitionBy(*keys).orderBy(*order)
    return (df.join(offsets, keys, "inner")
            .withColumn(idx_col, (F.col("_off") + F.row_number().over(w_in)).cast("long"))
            .drop("_off"))
