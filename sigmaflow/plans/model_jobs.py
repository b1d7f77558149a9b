"""Variance paths, saved states and forecasts resumed from them, without a refit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmaflow.config import Params
from sigmaflow.functions.columns import ntz_lit
from sigmaflow.operators import garch as G
from sigmaflow.operators import timeseries as ts
from sigmaflow.operators import variance_path as V
from sigmaflow.session import materialize
from sigmaflow.sources.model_store import ModelStore


def path_models(fits: DataFrame, returns: DataFrame, params: Params) -> DataFrame:
    """``series, distribution, alpha, beta, h_first``: fits, and the first variance of their in-sample recursion."""
    first = V.sample_variance(ts.in_sample(returns, params))
    return materialize(fits.select("series", "distribution", "alpha", "beta").join(first, "series"), "path-models")


def fitted_path(fits: DataFrame, returns: DataFrame, params: Params) -> DataFrame:
    """Variance of every bar under the in-sample fits; bars after the origin are filtered with the same parameters."""
    path = V.variance_path(returns, path_models(fits, returns, params))
    return path.withColumn("in_sample", F.col("day") <= ntz_lit(params.origin_day))


STATE = ("series", "distribution", "alpha", "persistence", "beta", "nu", "loglik", "n_obs", "last_date", "r_last", "h_last", "h_next")


def fitted_states(fits: DataFrame, returns: DataFrame, params: Params) -> DataFrame:
    """Model rows to save: parameters, and the state after the last in-sample bar."""
    inside = ts.in_sample(returns, params)
    ends = V.day_end_states(inside, path_models(fits, returns, params))
    last = ends.groupBy("series").agg(F.max("day").alias("day"))
    ends = ends.join(last, ["series", "day"])
    return (fits.drop("h_next").join(ends.select("series", "distribution", "last_date", "r_last", "h_last", "h_next"), ["series", "distribution"])
            .select(*STATE))


def after(states: DataFrame, returns: DataFrame) -> DataFrame:
    """Returns later than each saved state; all of its models stand at the same bar."""
    saved = states.groupBy("series").agg(F.max("last_date").alias("_saved"))
    return ts.spread_join(returns, saved, ["series"]).where(F.col("date") > F.col("_saved")).drop("_saved")


def advanced(states: DataFrame, returns: DataFrame) -> DataFrame:
    """The saved states carried over the returns that came since, without a refit; series without new returns stay."""
    new = after(states, returns)
    models = states.select("series", "distribution", "alpha", "beta", F.col("h_next").alias("h_first"))
    ends = V.day_end_states(new, models)
    last = ends.groupBy("series").agg(F.max("day").alias("day"))
    ends = ends.join(last, ["series", "day"]).select("series", "distribution", *(F.col(c).alias(f"_{c}") for c in ("last_date", "r_last", "h_last", "h_next")))
    moved = states.join(ends, ["series", "distribution"], "left")
    is_new = F.col("_last_date").isNotNull()
    return moved.select(*(F.when(is_new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("last_date", "r_last", "h_last", "h_next") else F.col(c) for c in STATE))


def resumed_forecasts(states: DataFrame, returns: DataFrame) -> DataFrame:
    """``series, distribution, day, n_ahead, h_start, daily_variance_forecast`` of every day after the saved state.

    Each day is forecast from the state at the end of the day before, with the saved parameters.
    """
    days = V.numbered_days(V.day_rows(after(states, returns)))
    models = states.select("series", "distribution", "alpha", "beta", F.col("h_next").alias("h_first"))
    starts = V.starting_variances(days, models, ["distribution"])
    rows = (days.select("series", "day", "idx", F.size("bars").cast("long").alias("n_ahead")).join(starts, ["series", "idx"])
            .join(states.select("series", "distribution", "persistence"), ["series", "distribution"]))
    return rows.select("series", "distribution", "day", "n_ahead", F.col("h_in").alias("h_start"),
                       G.daily_variance_expr("h_in").alias("daily_variance_forecast"))


def save_states(spark: SparkSession, root: str, fits: DataFrame, returns: DataFrame, params: Params) -> ModelStore:
    """A store whose first version has the in-sample fits."""
    store = ModelStore(spark, root)
    store.save(fitted_states(fits, returns, params))
    return store
