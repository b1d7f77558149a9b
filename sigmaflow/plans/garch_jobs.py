"""GARCH fit and forecast jobs over series x windows x candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmaflow.config import DEFAULT_GRID, DISTRIBUTIONS, GarchGrid, Params
from sigmaflow.functions.stats import normal_two_sided_sql, significant_sql
from sigmaflow.operators import garch as G
from sigmaflow.operators import windows as W


#: Consecutive windows of which one is started from the grid and the others from their neighbour's fit.
WARM_WINDOWS = 16


class FitInputs:
    """Day table, per-day arrays and windows of one return series table."""

    def __init__(self, returns: DataFrame, params: Params):
        self.returns, self.params = returns, params
        self.days = W.day_table(returns)
        self.arrays = W.day_arrays(returns, self.days)
        self.windows = W.rolling_windows(returns, params, self.days)
        self.in_sample = W.in_sample_window(returns, params, self.days)

    def samples(self, windows: DataFrame) -> DataFrame:
        """One array per window (used by the JVM scan and the in-sample fits)."""
        return W.window_arrays(windows, self.arrays)

    def blocks(self, windows: DataFrame, windows_per_block: int | None = None) -> DataFrame:
        """Blocks of consecutive windows sharing one copy of their days (rolling refits).

        By default up to 16 windows a block; fewer when the whole job has few windows,
        so that there are about four blocks per core to balance the CPU-heavy fits.
        """
        if windows_per_block is None:
            windows_per_block = block_size(windows)
        return W.window_blocks(windows, self.arrays, windows_per_block)


def block_size(windows: DataFrame, max_per_block: int = 16) -> int:
    """Windows per block: at most ``max_per_block``, at least about four blocks per core."""
    spark = windows.sparkSession
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - remote sessions
        cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_windows = windows.count()  # one row per window: a small table
    return int(max(1, min(max_per_block, -(-n_windows // (4 * cores)))))


def grid_loglik_table(spark: SparkSession, fi: FitInputs, grid: GarchGrid = DEFAULT_GRID,
                      distributions: tuple[str, ...] = DISTRIBUTIONS) -> DataFrame:
    """In-sample log-likelihood of every candidate, per series."""
    samples = fi.samples(fi.in_sample)
    return G.grid_loglik(samples, ["series", "window_id"], grid, distributions)


def in_sample_grid_fit(spark: SparkSession, fi: FitInputs, grid: GarchGrid = DEFAULT_GRID) -> DataFrame:
    """Best grid candidate per series and distribution on the in-sample days."""
    fits = G.grid_fit_numpy(fi.samples(fi.in_sample), ["series", "window_id"], grid)
    return fits.join(fi.in_sample.select("series", "target_day", "n_ahead"), "series", "inner")


def rolling_grid_forecast(spark: SparkSession, fi: FitInputs, forc_style: str,
                          grid: GarchGrid = DEFAULT_GRID) -> DataFrame:
    """Refit every window on the grid, forecast the next day, sum to a daily variance."""
    fits = G.grid_fit_numpy(fi.blocks(fi.windows), ["series", "window_id"], grid)
    return forecast_from_fits(fits, fi, forc_style)


def rolling_mle_forecast(spark: SparkSession, fi: FitInputs, forc_style: str,
                         grid: GarchGrid = DEFAULT_GRID) -> DataFrame:
    """Refit every window by refined ML (no standard errors), forecast the next day.

    Blocks have ``WARM_WINDOWS`` windows on any cluster, since a window starts where its neighbour in the block ended.
    """
    fits = G.mle_fit_numpy(fi.blocks(fi.windows, WARM_WINDOWS), ["series", "window_id"], grid, with_se=False)
    return forecast_from_fits(fits, fi, forc_style)


def forecast_from_fits(fits: DataFrame, fi: FitInputs, forc_style: str) -> DataFrame:
    """Daily variance of the next day: the step variances of its ``n_ahead`` steps, summed
    inside the row (no join back, so the fit job runs once)."""
    fits = fits.join(
        fi.windows.select("series", "window_id", "target_day", "n_ahead"), ["series", "window_id"], "inner")
    return fits.select("series", "distribution", F.lit(forc_style).alias("forc_style"),
                       F.col("target_day").alias("day"), "window_id", "alpha", "beta", "nu", "loglik",
                       G.daily_variance_expr().alias("daily_variance_forecast"))


def in_sample_mle(fi: FitInputs, grid: GarchGrid = DEFAULT_GRID, with_se: bool = True) -> DataFrame:
    """Refined in-sample ML fit per series and distribution (out-of-sample days held out)."""
    return G.mle_fit_numpy(fi.samples(fi.in_sample), ["series", "window_id"], grid, with_se=with_se)


SE_DIGITS = 8
COEF_NAMES = ("alpha", "beta", "nu")


def coefficient_table(fits: DataFrame, sampling: str) -> DataFrame:
    """Robust coefficient matrix rows: estimate, robust std error, t value, p value (normal).

    The fixed omega row is not reported; nu only for Student-t. Standard errors come from exact derivatives
    and are given, like the t values, at eight significant digits.
    """
    rows = F.array(*[F.struct(F.lit(c).alias("coefficient"), F.col(c).alias("estimate"),
                              F.col(f"se_{c}").alias("robust_se")) for c in COEF_NAMES])
    out = fits.select("series", "distribution", "converged", "at_bound", F.inline(rows)).where(F.col("estimate").isNotNull())
    out = out.withColumn("t_value", F.try_divide(F.col("estimate"), F.col("robust_se")))
    return out.select("series", F.lit(sampling).alias("sampling"), "distribution", "coefficient", "estimate",
                      F.expr(significant_sql("robust_se", SE_DIGITS)).alias("robust_se"), F.expr(significant_sql("t_value", SE_DIGITS)).alias("t_value"), F.expr(normal_two_sided_sql("t_value")).alias("p_value"), "converged", "at_bound")
