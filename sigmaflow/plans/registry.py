"""Registry of named queries: ``(spark, sf_dir) -> DataFrame``.

Floating results are rounded at the very end (6 places unless stated) so a
second engine that sums in another order produces the same digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigmaflow.functions.columns import round_doubles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str, digits: int = 6, overrides: dict[str, int] | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), digits, overrides)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        run.raw = fn  # unrounded version
        QUERIES[name] = run
        return run

    return deco
