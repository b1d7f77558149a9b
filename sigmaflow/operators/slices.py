"""Rows of arbitrary time slices (both ends closed, any second), as a binned interval join.

A slice ``lo .. hi`` is cut into bins of ``BIN`` and meets the rows by (series, bin): a hash join, where a
range condition would be a nested loop. Rows in a slice's first and last bin are compared with its ends; in the bins between
they belong to it without a look. Bins of more than ``HOT_ROWS`` rows are dealt over salts, and
the slices that touch them are repeated for each salt, so that a hot bin is many tasks.

Sums need no rows of the bins between: they come from one row a bin, so that a year's slice reads 365 rows and two days.

Defined results: an empty slice counts no rows; ``hi`` before ``lo``, or a null end, is an empty slice; rows without a date are in none;
overlapping and repeated slices each get their rows; null values count as rows and as ``n_null``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a bin in seconds, and the rows from which a bin is dealt over salts.
BIN = 86_400
HOT_ROWS = 1_000_000
#: Most hot bins whose table is broadcast (there is at most one in ``HOT_ROWS`` rows).
BROADCAST_ROWS = 1_000_000
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def bin_of(col: str, width: int = BIN) -> Column:
    """Number of the bin that holds a naive timestamp."""
    return F.expr(f"CAST(floor(timestampdiff(MICROSECOND, {EPOCH}, `{col}`) / {width * 1_000_000}) AS BIGINT)")


def _hot_bins(rows: DataFrame, hot_rows: int) -> DataFrame:
    """series, bin, salts of the bins with too many rows for one task."""
    counts = rows.groupBy("series", "_bin").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    return counts.select("series", "_bin", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))


def _with_salts(df: DataFrame, hot: DataFrame, broadcast: bool) -> DataFrame:
    return df.join(F.broadcast(hot) if broadcast else hot, ["series", "_bin"], "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))


def _meet(rows: DataFrame, pieces: DataFrame, hot_rows: int) -> DataFrame:
    """Rows and pieces of slices (series, _bin, _edge, slice_id, lo, hi) that hold them."""
    hot = _hot_bins(rows, hot_rows)
    small = hot.count() <= BROADCAST_ROWS
    salt = F.pmod(F.xxhash64(*(c for c in rows.columns if c != "_bin")), F.col("_salts").cast("long")).cast("int")
    left = _with_salts(rows, hot, small).withColumn("_salt", salt).drop("_salts")
    right = _with_salts(pieces, hot, small).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    met = left.join(right, ["series", "_bin", "_salt"])
    return met.where(~F.col("_edge") | F.col("date").between(F.col("lo"), F.col("hi")))


def _proper(slices: DataFrame) -> DataFrame:
    return slices.where(F.col("lo") <= F.col("hi")).select("series", "slice_id", "lo", "hi")


def slice_rows(rows: DataFrame, slices: DataFrame, width: int = BIN, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``series, slice_id, date, ...``: every row of every slice that holds it.

    rows: series, date, others. slices: series, slice_id, lo, hi.
    """
    first, last = bin_of("lo", width), bin_of("hi", width)
    pieces = _proper(slices).select("*", first.alias("_first"), last.alias("_last")).withColumn("_bin", F.explode(F.sequence("_first", "_last")))
    pieces = pieces.withColumn("_edge", (F.col("_bin") == F.col("_first")) | (F.col("_bin") == F.col("_last"))).drop("_first", "_last")
    met = _meet(rows.where("date IS NOT NULL").withColumn("_bin", bin_of("date", width)), pieces, hot_rows)
    return met.select("series", "slice_id", *(c for c in rows.columns if c != "series"))


def slice_sums(rows: DataFrame, slices: DataFrame, value: str, width: int = BIN, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``series, slice_id, lo, hi, n_rows, n_null, total, total_sq, first_date, last_date`` of every slice.

    The two edge bins are compared row by row; the bins between are read from one row a bin.
    """
    v = F.col(value)
    narrow = rows.where("date IS NOT NULL").select("series", "date", v.alias("_v")).withColumn("_bin", bin_of("date", width))
    sums = [F.count(F.lit(1)).alias("n"), F.count("_v").alias("n_set"), F.sum("_v").alias("s1"), F.sum(F.col("_v") * F.col("_v")).alias("s2"),
            F.min("date").alias("d0"), F.max("date").alias("d1")]
    cut = _proper(slices).select("*", bin_of("lo", width).alias("_first"), bin_of("hi", width).alias("_last"))
    edges = (cut.withColumn("_bin", F.explode(F.array_distinct(F.array("_first", "_last")))).withColumn("_edge", F.lit(True)).drop("_first", "_last"))
    at_edges = _meet(narrow, edges, hot_rows).groupBy("series", "slice_id").agg(*sums)
    bins = narrow.groupBy("series", "_bin").agg(*sums)
    between = cut.where(F.col("_last") - F.col("_first") > 1).withColumn("_bin", F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1)))
    inside = (between.join(bins, ["series", "_bin"]).groupBy("series", "slice_id")
              .agg(*(F.sum(c).alias(c) for c in ("n", "n_set", "s1", "s2")), F.min("d0").alias("d0"), F.max("d1").alias("d1")))
    both = (at_edges.unionByName(inside).groupBy("series", "slice_id")
            .agg(*(F.sum(c).alias(c) for c in ("n", "n_set", "s1", "s2")), F.min("d0").alias("d0"), F.max("d1").alias("d1")))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return (slices.select("series", "slice_id", "lo", "hi").join(both, ["series", "slice_id"], "left")
            .select("series", "slice_id", "lo", "hi", n.alias("n_rows"), (n - F.coalesce("n_set", F.lit(0).cast("long"))).alias("n_null"),
                    F.col("s1").alias("total"), F.col("s2").alias("total_sq"), F.col("d0").alias("first_date"), F.col("d1").alias("last_date")))


def day_slices(rows: DataFrame, after_seconds: int, length_seconds: int) -> DataFrame:
    """One slice for each (series, day) of the rows: it begins some seconds after the day's first row and has a fixed length.

    ``slice_id`` is the day's number since 1970.
    """
    days = rows.groupBy("series", F.to_date("date").alias("_day")).agg(F.min("date").alias("_d0")).where("_day IS NOT NULL")
    lo = F.expr(f"timestampadd(SECOND, {after_seconds}, _d0)")
    return (days.select("series", F.datediff("_day", F.lit("1970-01-01")).cast("long").alias("slice_id"), lo.alias("lo"))
            .withColumn("hi", F.expr(f"timestampadd(SECOND, {length_seconds}, lo)")))
