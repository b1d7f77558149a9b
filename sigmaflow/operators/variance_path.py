"""Conditional variance of every bar, as a distributed scan of affine maps.

h_t = alpha r_{t-1}^2 + beta h_{t-1} is an affine map of h_{t-1}, and maps compose:
(A2, B2) after (A1, B1) is (A2 + B2 A1, B2 B1). So each day's returns are composed to one map (with one array
scan, all days at once), the maps before a day are composed over the one-row-per-day table in chunks of ``CHUNK``
and chunks of chunks, and each day then emits the variances of its bars from the variance it starts with.
No task holds more than a day of bars or a chunk of days, and no series is ever gathered. Models meet the days of their series by a
broadcast of counted size, beyond it over salts. Give models as a stored table; they are read several times.

The same maps carry a saved state (last variance, last return) over new days without a refit.

A null return makes the variances after it null. Everything is JVM-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmaflow.operators.timeseries import spread_join

#: Days, or chunks, that one array scan composes.
CHUNK = 64


def day_rows(returns: DataFrame, value_col: str = "return") -> DataFrame:
    """One row per (series, day): its bars in time order as an array of (date, v)."""
    return (returns.groupBy("series", "day")
            .agg(F.array_sort(F.collect_list(F.struct("date", F.col(value_col).alias("v")))).alias("bars")))


def numbered_days(days: DataFrame) -> DataFrame:
    """``idx`` = 0, 1, ... of each day of its series, over the one-row-per-day table."""
    from pyspark.sql import Window
    keys = days.select("series", "day")
    return days.join(keys.withColumn("idx", F.row_number().over(Window.partitionBy("series").orderBy("day")).cast("long") - 1), ["series", "day"])


#: SQL: the map of a day's bars, oldest first, from an array ``bars`` of (date, v). The casts make the fields nullable, so that
#: a null variance is not read as 0.
DAY_MAP = ("aggregate(bars, CAST(named_struct('a', 0D, 'b', 1D) AS struct<a: double, b: double>), "
           "(m, x) -> named_struct('a', alpha * x.v * x.v + beta * m.a, 'b', beta * m.b))")
#: SQL: before each map of a chunk, the composition of those before it; and the whole chunk's map.
CHUNK_SCAN = ("aggregate(maps, CAST(named_struct('done', array(), 'a', 0D, 'b', 1D) "
              "AS struct<done: array<struct<idx: bigint, a: double, b: double>>, a: double, b: double>), (s, m) -> named_struct("
              "'done', concat(s.done, array(named_struct('idx', m.idx, 'a', s.a, 'b', s.b))), 'a', m.a + m.b * s.a, 'b', m.b * s.b))")
#: SQL: (date, r, h) of a day's bars, from the variance ``h_in`` of its first.
DAY_PATH = ("aggregate(bars, CAST(named_struct('done', array(), 'h', h_in) AS struct<done: array<struct<date: timestamp_ntz, r: double, h: double>>, h: double>), "
            "(s, x) -> named_struct('done', concat(s.done, array(named_struct('date', x.date, 'r', x.v, 'h', s.h))), "
            "'h', alpha * x.v * x.v + beta * s.h)).done")


def compose_before(maps: DataFrame, part: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """``part..., idx, a, b``: the composition of all maps of lower ``idx`` in the part (the identity for the first).

    maps: part, idx (0, 1, ...), a, b. Chunks are scanned on their own; their whole maps are composed the same way, until one chunk
    holds a part.
    """
    part = list(part)
    most = maps.agg(F.max("idx")).first()[0]  # one number: the days of the longest series
    chunks = (maps.groupBy(*part, F.expr(f"idx div {chunk}").alias("_chunk"))
              .agg(F.array_sort(F.collect_list(F.struct("idx", "a", "b"))).alias("maps"))
              .select(*part, "_chunk", F.expr(CHUNK_SCAN).alias("s")))
    inside = chunks.select(*part, "_chunk", F.inline("s.done"))
    if most is None or most < chunk:
        return inside.drop("_chunk")
    above = compose_before(chunks.select(*part, F.col("_chunk").alias("idx"), "s.a", "s.b"), part, chunk)
    above = above.select(*part, F.col("idx").alias("_chunk"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    return (inside.join(above, [*part, "_chunk"])
            .select(*part, "idx", (F.col("a") + F.col("b") * F.col("_a")).alias("a"), (F.col("b") * F.col("_b")).alias("b")))


def starting_variances(days: DataFrame, models: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """``series, keys..., idx, h_in``: the variance that each day's first bar has under each model.

    days: series, day, idx, bars. models: series, keys..., alpha, beta, h_first (the variance of the first bar).
    """
    part = ["series", *keys]
    maps = spread_join(days, models.select(*part, "alpha", "beta"), ["series"]).select(*part, "idx", F.expr(DAY_MAP).alias("m")).select(*part, "idx", "m.a", "m.b")
    before = compose_before(maps, part, chunk)
    return spread_join(before, models.select(*part, "h_first"), part).select(*part, "idx", (F.col("a") + F.col("b") * F.col("h_first")).alias("h_in"))


def variance_path(returns: DataFrame, models: DataFrame, keys: Sequence[str] = ("distribution",), chunk: int = CHUNK) -> DataFrame:
    """``series, keys..., day, date, return, h, sigma, std_resid`` of every bar under every model of its series.

    models: series, keys..., alpha, beta, and h_first, the variance of the series' first bar. The bars of a day stand in one row, once for
    each model; their number is bounded by the calendar.
    """
    days = numbered_days(day_rows(returns))
    part = ["series", *keys]
    starts = starting_variances(days, models, keys, chunk)
    rows = (spread_join(days.join(starts, ["series", "idx"]), models.select(*part, "alpha", "beta"), part)
            .select(*part, "day", F.inline(F.expr(DAY_PATH))))
    return rows.select(*part, "day", "date", F.col("r").alias("return"), "h", F.sqrt("h").alias("sigma"),
                       F.try_divide(F.col("r"), F.sqrt("h")).alias("std_resid"))


def day_end_states(returns: DataFrame, models: DataFrame, keys: Sequence[str] = ("distribution",), chunk: int = CHUNK) -> DataFrame:
    """``series, keys..., day, h_last, r_last, last_date, h_next``: the state after each day, and the variance of the bar that follows."""
    days = numbered_days(day_rows(returns))
    part = ["series", *keys]
    last = spread_join(days.join(starting_variances(days, models, keys, chunk), ["series", "idx"]), models.select(*part, "alpha", "beta"), part)
    end = last.select(*part, "day", "alpha", "beta", F.element_at(F.expr(DAY_PATH), -1).alias("e"))
    return end.select(*part, "day", F.col("e.h").alias("h_last"), F.col("e.r").alias("r_last"), F.col("e.date").alias("last_date"),
                      (F.col("alpha") * F.col("e.r") * F.col("e.r") + F.col("beta") * F.col("e.h")).alias("h_next"))


def sample_variance(returns: DataFrame) -> DataFrame:
    """``series, h_first``: the mean squared return of each series' rows (null if one is null), by partial aggregation."""
    r = F.col("return")
    whole = F.when(F.count(F.lit(1)) == F.count(r), F.avg(r * r))
    return returns.groupBy("series").agg(whole.alias("h_first"))
