"""Nested tables in bounded chunks: groups as arrays of structs, and models fitted to each group.

A group may hold a third of all rows, so it is never one value: its rows are dealt by hash into about n / ``CHUNK_ROWS`` buckets, numbered
inside each bucket and cut every ``CHUNK_ROWS`` rows. A chunk has at most that many rows, also of equal rows. A model
of a group is made from what each chunk adds (sums, counts, extremes), never from the group's rows in one place.

Defined results: null keys are a group; rows that repeat stay as often; an empty table gives no chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmaflow.operators.timeseries import spread_join

CHUNK_ROWS = 4_096


def nest(df: DataFrame, by: Sequence[str], chunk_rows: int = CHUNK_ROWS, name: str = "data") -> DataFrame:
    """``by..., chunk, n, data``: the other columns of a chunk's rows as an array of structs."""
    by = list(by)
    rest = [c for c in df.columns if c not in by]
    key = F.struct(*(F.col(f"`{c}`") for c in by))
    coded = df.select("*", F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in by)).alias("_g"))
    buckets = coded.groupBy("_g").agg(F.ceil(F.count("*") / chunk_rows).alias("_buckets"))  # one row a group
    dealt = spread_join(coded, buckets, ["_g"]).withColumn("_bucket", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rest)), F.col("_buckets")))
    w = Window.partitionBy("_g", "_bucket", *(F.col(f"`{c}`") for c in by)).orderBy(*(F.col(f"`{c}`") for c in rest))
    cut = dealt.withColumn("_piece", F.floor((F.row_number().over(w) - 1) / chunk_rows))
    out = (cut.groupBy(key.alias("_key"), "_bucket", "_piece")
           .agg(F.count("*").alias("n"), F.collect_list(F.struct(*(F.col(f"`{c}`") for c in rest))).alias(name)))
    return out.select("_key.*", F.struct(F.col("_bucket").alias("bucket"), F.col("_piece").alias("piece")).alias("chunk"), "n", name)


def unnest(nested: DataFrame, name: str = "data") -> DataFrame:
    """The rows of a nested table; as ``unnest(nest(df))`` has the rows of ``df``."""
    keys = [c for c in nested.columns if c not in ("chunk", "n", name)]
    return nested.select(*(F.col(f"`{c}`") for c in keys), F.inline(name))


def over_chunk(name: str, value: str) -> Column:
    """Sum over a chunk's rows of an SQL expression of ``x``, a row; rows where it is null add nothing."""
    return F.expr(f"aggregate({name}, 0D, (acc, x) -> acc + coalesce(CAST({value} AS DOUBLE), 0D))")


def map_lm(nested: DataFrame, by: Sequence[str], y: str, x: str, name: str = "data") -> DataFrame:
    """``by..., nobs, intercept, slope, r_squared, sse``: the line of y on x fitted to each group of a nested table.

    Two passes over the chunks: means first, then centred sums, so that no digits are lost to large means. Rows with a null on a side are skipped.
    """
    by = list(by)
    both = f"x.`{x}` IS NOT NULL AND x.`{y}` IS NOT NULL"
    at = lambda e: f"CASE WHEN {both} THEN {e} END"
    first = nested.groupBy(*by).agg(F.sum(over_chunk(name, at("1"))).alias("_n"), F.sum(over_chunk(name, at(f"x.`{x}`"))).alias("_sx"),
                                    F.sum(over_chunk(name, at(f"x.`{y}`"))).alias("_sy"))
    means = first.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_n", F.try_divide("_sx", "_n").alias("_mx"), F.try_divide("_sy", "_n").alias("_my"))
    same = [nested[c].eqNullSafe(means[f"_k{i}"]) for i, c in enumerate(by)]
    met = nested.join(means, same)
    dx, dy = f"(x.`{x}` - _mx)", f"(x.`{y}` - _my)"
    sums = met.groupBy(*by).agg(F.first("_n").alias("_n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"),
                                F.sum(over_chunk(name, at(f"{dx} * {dx}"))).alias("sxx"), F.sum(over_chunk(name, at(f"{dx} * {dy}"))).alias("sxy"),
                                F.sum(over_chunk(name, at(f"{dy} * {dy}"))).alias("syy"))
    slope = F.try_divide("sxy", "sxx")
    return sums.select(*by, F.col("_n").cast("long").alias("nobs"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"), slope.alias("slope"),
                       F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")).alias("r_squared"),
                       (F.col("syy") - slope * F.col("sxy")).alias("sse"))
