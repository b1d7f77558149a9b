"""Rolling-origin windows for daily refits (moving window, one day ahead).

Per series, days with returns are numbered 1..m (a window over the
one-row-per-day table, bounded by the calendar). With ``o`` = the index of
the first day on or after the forecast origin day, window ``i`` (1..m-o)
fits days ``i .. o+i-1`` and forecasts day ``o+i``: each step drops the
oldest day and adds the newest. Window 0 is the in-sample fit (days 1..o).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigmaflow.config import EPOCH, Params
from sigmaflow.functions.columns import ntz_lit


def day_table(returns: DataFrame) -> DataFrame:
    """One row per (series, day): index, last timestamp, row count, running count."""
    w = Window.partitionBy("series").orderBy("day")
    return (returns.groupBy("series", "day")
            .agg(F.max("date").alias("day_end"), F.count(F.lit(1)).cast("long").alias("n_rows"))
            .withColumn("day_idx", F.row_number().over(w).cast("long"))
            .withColumn("cum_rows", F.sum("n_rows").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def day_ends(returns: DataFrame) -> DataFrame:
    """Distinct day ends per series with the epoch prepended as index 0."""
    d = day_table(returns).select("series", "day_idx", "day_end")
    epoch = (d.select("series").distinct()
             .select("series", F.lit(0).cast("long").alias("day_idx"),
                     ntz_lit(EPOCH).alias("day_end")))
    return d.unionByName(epoch)


def rolling_windows(returns: DataFrame, params: Params, days: DataFrame | None = None) -> DataFrame:
    """``series, window_id, fit_first_idx, fit_last_idx, target_idx, fit_first_day,
    fit_last_day, target_day, lo, fit_hi, hi, n_fit, n_ahead``.

    ``lo`` is exclusive (the previous day's end, the epoch for window 1), ``hi``
    inclusive, matching an ``a/b`` slice of ``lo + 1s`` to ``hi``.
    """
    d = days if days is not None else day_table(returns)
    origin = ntz_lit(params.origin_day)
    o = d.where(F.col("day") >= origin).groupBy("series").agg(F.min("day_idx").alias("_o"))
    tgt = (d.join(o, "series", "inner").where(F.col("day_idx") > F.col("_o"))
           .select("series", (F.col("day_idx") - F.col("_o")).alias("window_id"),
                   (F.col("day_idx") - F.col("_o")).alias("fit_first_idx"),
                   (F.col("day_idx") - 1).alias("fit_last_idx"),
                   F.col("day_idx").alias("target_idx"), F.col("day").alias("target_day"),
                   F.col("day_end").alias("hi"), F.col("n_rows").alias("n_ahead")))
    first = d.select("series", F.col("day_idx").alias("fit_first_idx"), F.col("day").alias("fit_first_day"),
                     (F.col("cum_rows") - F.col("n_rows")).alias("_cum_before"))
    before = d.select("series", (F.col("day_idx") + 1).alias("fit_first_idx"), F.col("day_end").alias("lo"))
    last = d.select("series", F.col("day_idx").alias("fit_last_idx"), F.col("day").alias("fit_last_day"),
                    F.col("day_end").alias("fit_hi"), F.col("cum_rows").alias("_cum_last"))
    return (tgt.join(first, ["series", "fit_first_idx"], "inner")
            .join(before, ["series", "fit_first_idx"], "left")
            .join(last, ["series", "fit_last_idx"], "inner")
            .select("series", F.col("window_id").cast("long").alias("window_id"),
                    "fit_first_idx", "fit_last_idx", "target_idx",
                    "fit_first_day", "fit_last_day", "target_day",
                    F.coalesce("lo", ntz_lit(EPOCH)).alias("lo"),
                    "fit_hi", "hi",
                    (F.col("_cum_last") - F.col("_cum_before")).cast("long").alias("n_fit"),
                    F.col("n_ahead").cast("long").alias("n_ahead")))


def in_sample_window(returns: DataFrame, params: Params, days: DataFrame | None = None) -> DataFrame:
    """Window 0: every day up to the origin day (the in-sample fit, ``out.sample`` held out)."""
    d = days if days is not None else day_table(returns)
    origin = ntz_lit(params.origin_day)
    ins = d.where(F.col("day") <= origin)
    nxt = (d.where(F.col("day") > origin).groupBy("series")
           .agg(F.min_by(F.struct("day", "n_rows"), F.col("day")).alias("_next")))
    return (ins.groupBy("series").agg(F.max("day_idx").alias("fit_last_idx"),
                                      F.sum("n_rows").cast("long").alias("n_fit"))
            .join(nxt, "series", "left")
            .select("series", F.lit(0).cast("long").alias("window_id"),
                    F.lit(1).cast("long").alias("fit_first_idx"), "fit_last_idx",
                    F.col("_next.day").alias("target_day"),
                    F.col("n_fit"), F.col("_next.n_rows").cast("long").alias("n_ahead")))


def day_arrays(returns: DataFrame, days: DataFrame, value_col: str = "return") -> DataFrame:
    """One row per (series, day_idx) holding that day's values in time order.

    A day holds at most one day of bars, so each array is small; a window's
    data is then a join on ``(series, day_idx)`` — hash partitioned, no range
    condition and no per-series task.
    """
    arr = (returns.groupBy("series", "day")
           .agg(F.array_sort(F.collect_list(F.struct("date", F.col(value_col).alias("v")))).alias("_s")))
    return (arr.join(days.select("series", "day", "day_idx"), ["series", "day"], "inner")
            .select("series", "day_idx", F.transform("_s", lambda s: s["v"]).alias("values")))


def window_days(windows: DataFrame) -> DataFrame:
    """(series, window_id, day_idx) for every fit day of every window."""
    return windows.select("series", "window_id",
                          F.explode(F.sequence("fit_first_idx", "fit_last_idx")).alias("day_idx"))


def window_arrays(windows: DataFrame, arrays: DataFrame) -> DataFrame:
    """Per window, the fit sample as one array in time order (bounded by the window length)."""
    joined = window_days(windows).join(arrays, ["series", "day_idx"], "inner")
    per = (joined.groupBy("series", "window_id")
           .agg(F.array_sort(F.collect_list(F.struct("day_idx", "values"))).alias("_d")))
    return per.select("series", "window_id", F.flatten(F.transform("_d", lambda s: s["values"])).alias("r"))


def window_rows(windows: DataFrame, returns: DataFrame, days: DataFrame) -> DataFrame:
    """Row count and sum of squares of each window's fit sample (the time slice).

    Running sums over the day table, taken at both ends of a window; no window is expanded to its days.
    """
    upto = Window.partitionBy("series").orderBy("day_idx").rowsBetween(Window.unboundedPreceding, 0)
    per_day = (returns.groupBy("series", "day").agg(F.sum(F.col("return") * F.col("return")).alias("_ss"))
               .join(days.select("series", "day", "day_idx"), ["series", "day"], "inner")
               .select("series", "day_idx", F.sum(F.coalesce("_ss", F.lit(0.0))).over(upto).alias("_cum"),
                       F.coalesce("_ss", F.lit(0.0)).alias("_ss")))
    first = per_day.select("series", F.col("day_idx").alias("fit_first_idx"), (F.col("_cum") - F.col("_ss")).alias("_before"))
    last = per_day.select("series", F.col("day_idx").alias("fit_last_idx"), F.col("_cum").alias("_upto"))
    return (windows.join(first, ["series", "fit_first_idx"]).join(last, ["series", "fit_last_idx"])
            .select("series", "window_id", F.col("n_fit").alias("n_rows"), (F.col("_upto") - F.col("_before")).alias("sum_sq")))


def window_blocks(windows: DataFrame, arrays: DataFrame, windows_per_block: int = 16) -> DataFrame:
    """Consecutive windows of a series grouped into blocks that share one copy of their days.

    A window's sample overlaps its neighbour's in all but one day, so shipping every
    window separately copies each day into up to ``fit days`` windows. A block ships
    the union of its windows' days once (``days``: sorted day arrays) plus the
    window bounds (``wins``); the fit kernel slices each window locally. The
    shuffle shrinks by about ``windows_per_block`` and a task still holds a bounded
    sample (fit length + block length days).
    """
    blk = windows.withColumn("block_id", F.floor((F.col("window_id") - 1) / windows_per_block).cast("long"))
    spans = (blk.groupBy("series", "block_id")
             .agg(F.min("fit_first_idx").alias("_lo"), F.max("fit_last_idx").alias("_hi"),
                  F.array_sort(F.collect_list(F.struct(
                      F.col("window_id").cast("long").alias("window_id"),
                      F.col("fit_first_idx").cast("long").alias("fit_first_idx"),
                      F.col("fit_last_idx").cast("long").alias("fit_last_idx")))).alias("wins")))
    days = (spans.select("series", "block_id", F.explode(F.sequence("_lo", "_hi")).alias("day_idx"))
            .join(arrays, ["series", "day_idx"], "inner")
            .groupBy("series", "block_id")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("day_idx").cast("long").alias("day_idx"),
                                                      "values"))).alias("days")))
    return days.join(spans.select("series", "block_id", "wins"), ["series", "block_id"], "inner")
