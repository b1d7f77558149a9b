"""Evaluation datasets: forecasts joined with proxies, comparisons, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.config import Params
from sigmaflow.functions.columns import ntz_lit, recode
from sigmaflow.operators import evaluate as ev
from sigmaflow.operators.reshape import gather, spread
from sigmaflow.operators.timeseries import out_of_sample

# Display labels and the printed row order of the result table.
METRIC_LABELS = {
    "mape": "MAPE",
    "rmse": "RMSE",
    "(Intercept)_estimate": "MZ Intercept",
    "(Intercept)_std.error": "MZ Intercept Std. Error",
    "daily_variance_forecast_estimate": "MZ Slope",
    "daily_variance_forecast_std.error": "MZ Slope Std. Error",
    "r.squared": "MZ $R^2$",
}
STD_ERROR_METRICS = ("MZ Intercept Std. Error", "MZ Slope Std. Error")
STYLE_LABELS_NORMAL = {"5min": "GARCH(1,1)-N 5-min", "daily": "GARCH(1,1)-N daily",
                       "realized_variance": "Realized Variance"}
DIST_LABELS = {"Normal": "GARCH(1,1)-N", "Student-t": "GARCH(1,1)-T",
               "realized_variance": "Realized Variance"}
FILTER_LABELS = {"5min": "GARCH(1,1)-N 5-min", "5min_filtered": "GARCH(1,1)-N 5-min-filtered",
                 "realized_variance": "Realized Variance"}
STUDENT_T_SCALE = 1.1
PROXIES = ("realized_variance", "squared_return")


def naive_forecasts(rv_all: DataFrame, rv_filtered_all: DataFrame, params: Params) -> DataFrame:
    """Stand-in daily variance forecasts built from past realized variance.

    '5min' = previous day's RV, 'daily' = mean of the previous five RVs,
    '5min_filtered' = previous day's RV of outlier-replaced returns; the
    Student-t rows are the Normal ones times 1.1. Windows run over the
    one-row-per-day RV table (bounded by the calendar, not the tick volume).
    """
    w = Window.partitionBy("series").orderBy("day")
    prev5 = w.rowsBetween(-5, -1)
    base = rv_all.select(
        "series", "day",
        F.lag("realized_variance").over(w).alias("5min"),
        F.when(F.count("realized_variance").over(prev5) == 5,
               F.avg("realized_variance").over(prev5)).alias("daily"))
    filt = rv_filtered_all.select("series", "day",
                                  F.lag("realized_variance").over(w).alias("5min_filtered"))
    wide = base.join(filt, ["series", "day"], "inner")
    long = gather(wide, ["series", "day"], ["5min", "daily", "5min_filtered"], "forc_style",
                  "daily_variance_forecast").where(F.col("daily_variance_forecast").isNotNull())
    dists = long.withColumn("distribution", F.explode(F.array(F.lit("Normal"), F.lit("Student-t"))))
    fc = dists.withColumn(
        "daily_variance_forecast",
        F.when(F.col("distribution") == "Student-t", F.col("daily_variance_forecast") * STUDENT_T_SCALE)
        .otherwise(F.col("daily_variance_forecast")))
    return out_of_sample(fc, params).select("series", "distribution", "forc_style", "day",
                                            "daily_variance_forecast")


def attach_proxies(forecasts: DataFrame, rv: DataFrame, sq: DataFrame) -> DataFrame:
    """Forecasts left-joined with both proxies on (series, day)."""
    return (forecasts
            .join(rv.select("series", "day", "realized_variance"), ["series", "day"], "left")
            .join(sq.select("series", "day", "squared_return"), ["series", "day"], "left"))


def performance_data(forecasts: DataFrame, rv: DataFrame, sq: DataFrame,
                     params: Params) -> DataFrame:
    """'5min' and 'daily' rows, plus '5min_no_outlier' = '5min' without one named day."""
    two = forecasts.where(F.col("forc_style").isin("5min", "daily"))
    joined = attach_proxies(two, rv, sq)
    out = joined
    if params.excluded_day is not None:
        excl = ntz_lit(params.excluded_day)
        no_outlier = (joined.where((F.col("forc_style") == "5min") & (F.col("day") != excl))
                      .withColumn("forc_style", F.lit("5min_no_outlier")))
        out = joined.unionByName(no_outlier)
    return out


def performance_data_filtered(forecasts: DataFrame, rv: DataFrame, sq: DataFrame) -> DataFrame:
    """Three styles: '5min', '5min_filtered' (outlier-replaced model) and 'daily'."""
    three = forecasts.where(F.col("forc_style").isin("5min", "5min_filtered", "daily"))
    return attach_proxies(three, rv, sq)


def compare_long(forecasts: DataFrame, rv: DataFrame, key: str, keep: str, values: list[str],
                 labels: dict[str, str]) -> DataFrame:
    """Spread ``key`` into columns next to realized variance, gather back with labels."""
    joined = forecasts.join(rv.select("series", "day", "realized_variance"), ["series", "day"], "left")
    wide = spread(joined, ["series", "day", keep, "realized_variance"], key,
                  "daily_variance_forecast", {v: v for v in values})
    long = gather(wide, ["series", "day", keep], values + ["realized_variance"], "metric",
                  "variance_estimate")
    return long.withColumn("metric", recode("metric", labels))


def compare_styles_long(forecasts: DataFrame, rv: DataFrame) -> DataFrame:
    f = forecasts.where((F.col("distribution") == "Normal") & F.col("forc_style").isin("5min", "daily"))
    return compare_long(f, rv, "forc_style", "distribution", ["5min", "daily"], STYLE_LABELS_NORMAL)


def compare_dists_long(forecasts: DataFrame, rv: DataFrame) -> DataFrame:
    f = forecasts.where(F.col("forc_style") == "5min")
    return compare_long(f, rv, "distribution", "forc_style", ["Normal", "Student-t"], DIST_LABELS)


def compare_filtered_long(forecasts: DataFrame, rv: DataFrame) -> DataFrame:
    f = forecasts.where((F.col("distribution") == "Normal") & F.col("forc_style").isin("5min", "5min_filtered"))
    return compare_long(f, rv, "forc_style", "distribution", ["5min", "5min_filtered"], FILTER_LABELS)


def proxy_long_perf(perf: DataFrame) -> DataFrame:
    """Normal rows, with the two proxies stacked as ``(proxy, variance_proxy)``."""
    normal = perf.where(F.col("distribution") == "Normal")
    return gather(normal, ["series", "forc_style", "day", "daily_variance_forecast"], list(PROXIES),
                  "proxy", "variance_proxy")


def metric_long(perf: DataFrame) -> DataFrame:
    """(series, proxy, forc_style, metric, value) for the seven printed metrics, from a
    single aggregation pass per (series, style, proxy)."""
    grp = ("series", "forc_style", "proxy")
    s = ev.summary(proxy_long_perf(perf), "variance_proxy", grp)
    pairs = [("mape", "mape"), ("rmse", "rmse"), ("(Intercept)_estimate", "intercept"),
             ("(Intercept)_std.error", "se_intercept"), ("daily_variance_forecast_estimate", "slope"),
             ("daily_variance_forecast_std.error", "se_slope"), ("r.squared", "r_squared")]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in pairs])
    return s.select(*grp, F.inline(rows))


def result_table(perf: DataFrame, styles: dict[str, str]) -> DataFrame:
    """Metric x style table per proxy; ``styles`` maps forc_style to the output column.

    Rows ordered by proxy then the printed metric order (``metric_rank``).
    """
    long = metric_long(perf).where(F.col("forc_style").isin(*styles))
    wide = spread(long, ["series", "proxy", "metric"], "forc_style", "value", styles)
    rank = F.create_map(*[x for i, k in enumerate(METRIC_LABELS) for x in (F.lit(k), F.lit(i + 1))])
    return (wide.withColumn("metric_rank", rank[F.col("metric")].cast("long"))
            .withColumn("metric", recode("metric", METRIC_LABELS))
            .select("series", "proxy", "metric_rank", "metric", *styles.values())
            .orderBy("series", "proxy", "metric_rank"))


def result_table_display(table: DataFrame, digits: int = 5) -> DataFrame:
    """Printed form: every column of a fractional type (found from the schema) rounded and shown with
    ``digits`` places; standard-error rows in parentheses with no label."""
    styles = [f.name for f in table.schema.fields if isinstance(f.dataType, (T.FractionalType, T.DecimalType))]
    is_se = F.col("metric").isin(*STD_ERROR_METRICS)
    fmt = f"%.{digits}f"
    cols = [
        F.when(F.col(c).isNull(), F.lit(None).cast("string"))
        .when(is_se, F.format_string(f"({fmt})", F.round(F.col(c), digits)))
        .otherwise(F.format_string(fmt, F.round(F.col(c), digits))).alias(c)
        for c in styles
    ]
    return table.select("series", "proxy", "metric_rank",
                        F.when(is_se, F.lit(None).cast("string")).otherwise(F.col("metric")).alias("metric"),
                        *cols)
