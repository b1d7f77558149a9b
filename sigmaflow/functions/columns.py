"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.config import BAR_INTERVAL

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ts_to_epoch(col: str) -> Column:
    """Whole epoch seconds of a naive timestamp column, independent of the session zone."""
    return F.expr(f"timestampdiff(SECOND, {_EPOCH_NTZ}, `{col}`)")


def epoch_to_ts(col: str) -> Column:
    """Epoch seconds column -> naive timestamp (the ``as.POSIXct(x, origin=1970-01-01)`` step)."""
    return F.expr(f"timestampadd(SECOND, CAST(`{col}` AS BIGINT), {_EPOCH_NTZ})")


def ntz_lit(value) -> Column:
    """A naive timestamp literal (datetime or date) that no session time zone can shift."""
    import datetime as _dt
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    else:
        text = value.strftime("%Y-%m-%d 00:00:00")
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def floor_bar(col: str | Column, interval: str = BAR_INTERVAL) -> Column:
    """Start of the fixed bar containing the timestamp (floor to 5 minutes)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.window(c, interval).start


def day_of(col: str | Column) -> Column:
    """Calendar day of a naive timestamp."""
    c = F.col(col) if isinstance(col, str) else col
    return F.to_date(c)


def local_ts(col: str | Column, tz: str = "UTC") -> Column:
    """Wall clock in a zone of a naive UTC timestamp, by the zone's rules at that time."""
    c = F.col(col) if isinstance(col, str) else col
    return c if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), c)


def day_ts(col: str | Column, tz: str = "UTC") -> Column:
    """Midnight (wall clock) of the zone's calendar day that holds a naive UTC timestamp, as a naive timestamp."""
    return F.to_date(local_ts(col, tz)).cast("timestamp_ntz")


def day_hours(day: str | Column, tz: str = "UTC") -> Column:
    """Hours of a zone's calendar day: 24, but where its clock is changed."""
    c = F.col(day) if isinstance(day, str) else day
    utc = lambda t: F.convert_timezone(F.lit(tz), F.lit("UTC"), t)
    seconds = F.timestamp_diff("SECOND", utc(c), utc(c + F.expr("INTERVAL 1 DAY")))
    return seconds / 3600


def recode(col: str | Column, mapping: Mapping[str, str]) -> Column:
    """Relabel values; unmatched values pass through (like ``recode``)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for old, new in mapping.items():
        expr = (F.when(c == F.lit(old), F.lit(new)) if expr is None
                else expr.when(c == F.lit(old), F.lit(new)))
    return c if expr is None else expr.otherwise(c)


def round_doubles(df: DataFrame, digits: int = 6, overrides: Mapping[str, int] | None = None) -> DataFrame:
    """Round every double column (found from the schema), like ``mutate_if(is.numeric, round)``."""
    overrides = overrides or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), overrides.get(f.name, digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
