"""Reshaping helpers: long <-> wide with literal value lists, display formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, ids: Sequence[str], key: str, value: str,
           values: Mapping[str, str]) -> DataFrame:
    """Long -> wide. ``values`` maps key values to output column names (a literal list,
    so no extra job is needed to discover the pivot values)."""
    wide = df.groupBy(*ids).pivot(key, list(values)).agg(F.first(value))
    return wide.select(*ids, *[F.col(f"`{k}`").alias(v) for k, v in values.items()])


def gather(df: DataFrame, ids: Sequence[str], cols: Sequence[str], key: str, value: str) -> DataFrame:
    """Wide -> long over ``cols``."""
    return df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in cols], key, value)
