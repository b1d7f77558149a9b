"""Time-series operators: resampling, daily closes, log returns, outliers.

Price tables: ``series, date, adjusted[, tick_id]``. Return tables add
``day`` (midnight of the calendar day, naive timestamp) and ``return``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmaflow.config import BAR_INTERVAL, DEFAULT_KNOBS, OUTLIER_SD_MULTIPLIER, Params, ScaleKnobs
from sigmaflow.functions.columns import day_ts, floor_bar, ntz_lit
from sigmaflow.operators.sequence import bucket_column, with_previous


#: Parts up to which a table of one row per part is broadcast, and keys of a part beyond that.
BROADCAST_ROWS = 1_000_000
SALTS = 64


def _order_cols(df: DataFrame) -> list[str]:
    return ["date", "tick_id"] if "tick_id" in df.columns else ["date"]


def _order_key(df: DataFrame) -> Column:
    """One number that orders the rows of a bar or day by time, then ``tick_id``.

    Numbers keep ``min_by`` and ``max_by`` inside a hash aggregate, where a struct key would sort every
    tick. Microseconds since 1970 are below 10^17 (a day of a zone spans two UTC days, so an offset inside a day
    would not do), a tick id below 10^19: 36 digits.
    """
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', date)").cast("decimal(17,0)")
    if "tick_id" not in df.columns:
        return micros
    return micros * F.lit(Decimal(10**19)) + F.coalesce(F.col("tick_id"), F.lit(0)).cast("decimal(19,0)")


def bar_summary(prices: DataFrame, interval: str = BAR_INTERVAL) -> DataFrame:
    """First and last observation of every bar in one aggregation on ``(series, bar)``.

    Map-side partial aggregation shrinks ticks to bars before the shuffle, and a
    hot series spreads over its many bars. Both the 5-minute bars (first tick)
    and the daily closes (last tick of the day's last bar) come from this one
    pass over the tick table.
    """
    key = _order_key(prices)
    return (
        prices.groupBy("series", floor_bar("date", interval).alias("bar"))
        .agg(F.min("date").alias("first_date"), F.min_by("adjusted", key).alias("first_adjusted"),
             F.max("date").alias("last_date"), F.max_by("adjusted", key).alias("last_adjusted"))
    )


def bars_from_summary(summary: DataFrame) -> DataFrame:
    return summary.select("series", "bar", F.col("first_date").alias("date"),
                          F.col("first_adjusted").alias("adjusted"))


def daily_close_from_summary(summary: DataFrame, tz: str = "UTC") -> DataFrame:
    """Last observation of every day of the zone: the last tick of the day's last bar (no bar spans two days)."""
    return (summary.groupBy("series", day_ts("bar", tz).alias("day"))
            .agg(F.max("last_date").alias("date"), F.max_by("last_adjusted", "bar").alias("adjusted")))


def resample_bars(prices: DataFrame, interval: str = BAR_INTERVAL) -> DataFrame:
    """First observation of every bar, keeping that observation's own timestamp."""
    return (
        prices.groupBy("series", floor_bar("date", interval).alias("bar"))
        .agg(F.min("date").alias("date"), F.min_by("adjusted", _order_key(prices)).alias("adjusted"))
    )


def daily_close(prices: DataFrame, tz: str = "UTC") -> DataFrame:
    """Last observation of every calendar day of the zone, stamped with its own timestamp."""
    return (
        prices.groupBy("series", day_ts("date", tz).alias("day"))
        .agg(F.max("date").alias("date"), F.max_by("adjusted", _order_key(prices)).alias("adjusted"))
    )


def log_returns(prices: DataFrame, bucket: str = "day", tz: str = "UTC") -> DataFrame:
    """``log(p) - log(lag(p))`` per series, dropping only each series' first row; ``day`` is the zone's calendar day.

    Later null returns (a null price) stay, as with ``slice(-1)``. The lag is
    computed per ``(series, bucket)`` with a carry from the previous bucket, so
    no task ever holds a whole series.
    """
    order = _order_cols(prices)
    with_day = prices.withColumn("day", day_ts("date", tz))
    if bucket == "day":
        # bucket on ``day`` itself: later (series, day) aggregations reuse this partitioning
        out = with_previous(with_day, "adjusted", "_prev", ("series",), order, "day")
    else:
        out = with_previous(with_day.withColumn("_bucket", bucket_column("date", bucket)),
                            "adjusted", "_prev", ("series",), order, "_bucket").drop("_bucket")
    return (
        out.where(~F.col("_is_first"))
        .withColumn("return", F.ln("adjusted") - F.ln("_prev"))
        .drop("_prev", "_is_first")
    )


def intraday_returns(prices: DataFrame, interval: str = BAR_INTERVAL, tz: str = "UTC") -> DataFrame:
    """5-minute log returns: resample, then log-difference consecutive bars."""
    return log_returns(resample_bars(prices, interval), bucket="day", tz=tz)


def daily_returns(prices: DataFrame, tz: str = "UTC") -> DataFrame:
    """Daily log returns from the last price of each day (first day dropped)."""
    return log_returns(daily_close(prices, tz), bucket="year", tz=tz).drop("tick_id")


def collapse_to_daily(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Every row's ``date`` becomes the last timestamp of its calendar day."""
    w = Window.partitionBy("series", day_ts("date", tz))
    return df.withColumn("date", F.max("date").over(w))


def out_of_sample(df: DataFrame, params: Params, strict: bool = False) -> DataFrame:
    """Rows of days after the forecast origin day (``date > forecast_start`` on a 5-min grid).

    With ``strict`` the time of day of ``forecast_start`` counts too.
    """
    if strict:
        return df.where(F.col("date") > ntz_lit(params.utc(params.forecast_start)))
    return df.where(F.col("day") > ntz_lit(params.origin_day))


def in_sample(df: DataFrame, params: Params) -> DataFrame:
    return df.where(F.col("day") <= ntz_lit(params.origin_day))


def oos_count(returns: DataFrame, params: Params) -> DataFrame:
    """Number of out-of-sample returns per series (the ``out.sample`` size)."""
    oos = F.col("day") > ntz_lit(params.origin_day)
    return returns.groupBy("series").agg(
        F.count_if(oos).cast("long").alias("n_out_sample"),
        F.count_if(~oos).cast("long").alias("n_in_sample"))


def spread_join(df: DataFrame, per_part: DataFrame, part: list[str], how: str = "inner") -> DataFrame:
    """Join rows with a table of one row (or a few) per part, without bringing a part's rows together.

    Below ``BROADCAST_ROWS`` parts (counted) the small table is broadcast; beyond it, rows are
    dealt over ``SALTS`` keys of each part and the small table is repeated for each.
    """
    if per_part.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(per_part), part, how)
    salted = per_part.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    return df.withColumn("_salt", salt).join(salted, [*part, "_salt"], how).drop("_salt")


def _statistics(df: DataFrame, value_col: str, part: list[str], knobs: ScaleKnobs) -> DataFrame:
    """Per part, in one pass and a refinement where needed: n, sd and the exact median (mean of the
    two middle values for even n). Nulls are ignored.

    Spark's exact ``median`` keeps every distinct value of a group in one buffer,
    which a hot series cannot afford. Instead a histogram select: each pass
    counts the values of every still-wide part in ``median_buckets`` equal-width
    buckets of its current bracket (a hash aggregate with map-side combine) and
    narrows the bracket to the buckets holding the two middle ranks, until no
    bracket holds more than ``median_max_candidates`` values or several distinct
    ones; those are ranked exactly. Memory per task and the final ranking
    set are bounded by the knobs, not by the series length.
    """
    from sigmaflow.session import materialize

    n_buckets, max_cand = int(knobs.median_buckets), int(knobs.median_max_candidates)
    data = df.where(F.col(value_col).isNotNull()).select(*part, F.col(value_col).alias("_v"))
    base = materialize(data.groupBy(*part).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                               F.stddev_samp("_v").alias("_sd")), "median-base")
    state = base.select(*part, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_cnt"),
                        F.floor((F.col("_n") + 1) / 2).alias("_k1"), (F.floor(F.col("_n") / 2) + 1).alias("_k2"))
    while True:
        wide = state.where((F.col("_cnt") > max_cand) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():  # read from the stored state, one row per part
            break
        width = (F.col("_hi") - F.col("_lo")) / n_buckets
        bucket = F.least(F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)), F.lit(0)),
                         F.lit(n_buckets - 1)).cast("long")
        hist = (spread_join(data, wide, part)
                .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
                .groupBy(*part, "_below", "_k1", "_k2", bucket.alias("_b"))
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax")))
        upto = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_cum", F.col("_below") + F.sum("_c").over(upto))
        keep = hist.where((F.col("_cum") >= F.col("_k1")) & (F.col("_cum") - F.col("_c") < F.col("_k2")))
        narrowed = keep.groupBy(*part, "_k1", "_k2").agg(
            F.min("_bmin").alias("_lo"), F.max("_bmax").alias("_hi"),
            F.min(F.col("_cum") - F.col("_c")).cast("long").alias("_below"),
            F.sum("_c").cast("long").alias("_cnt"))
        untouched = state.join(wide.select(*part), part, "left_anti")
        state = materialize(untouched.unionByName(narrowed), "median-state")
    cand = (spread_join(data, state, part)
            .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            .groupBy(*part, "_below", "_k1", "_k2", "_v").agg(F.count(F.lit(1)).alias("_c")))
    w = Window.partitionBy(*part).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cand.withColumn("_cum", F.col("_below") + F.sum("_c").over(w))

    def at(k: str):
        return F.max(F.when((F.col("_cum") - F.col("_c") < F.col(k)) & (F.col(k) <= F.col("_cum")), F.col("_v")))

    median = ranked.groupBy(*part).agg(((at("_k1") + at("_k2")) / 2).alias("median"))
    return materialize(base.select(*part, F.col("_n").alias("n_obs"), F.col("_sd").alias("sd")).join(median, part), "part-statistics")


def exact_median(df: DataFrame, value_col: str, part: tuple[str, ...] = ("series",),
                 knobs: ScaleKnobs = DEFAULT_KNOBS) -> DataFrame:
    """Exact median of ``value_col`` per part (mean of the two middle values for even n)."""
    return _statistics(df, value_col, list(part), knobs).select(*part, "median")


def replace_outliers(returns: DataFrame, k: float = OUTLIER_SD_MULTIPLIER,
                     knobs: ScaleKnobs = DEFAULT_KNOBS) -> DataFrame:
    """Replace returns outside ``median +- k * sd`` (whole series, nulls ignored) by the median.

    Null returns stay null. The per-series statistics are one row per series.
    """
    stats = _statistics(returns, "return", ["series"], knobs).select("series", "median", F.col("sd").alias("_sd"))
    r = F.col("return")
    inside = r.between(F.col("median") - F.col("_sd") * k, F.col("median") + F.col("_sd") * k)
    return (spread_join(returns, stats, ["series"], "left")
            .withColumn("return", F.when(~inside, F.col("median")).otherwise(r))
            .select(*returns.columns))


def outlier_stats(returns: DataFrame, k: float = OUTLIER_SD_MULTIPLIER,
                  knobs: ScaleKnobs = DEFAULT_KNOBS) -> DataFrame:
    """Per series: median, sd and the replacement band (for inspection)."""
    stats = _statistics(returns, "return", ["series"], knobs)
    return (stats.select("series", "median", "sd", F.col("n_obs").cast("long").alias("n_obs"))
            .withColumn("lower", F.col("median") - F.col("sd") * k)
            .withColumn("upper", F.col("median") + F.col("sd") * k))
