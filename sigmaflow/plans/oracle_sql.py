"""DuckDB SQL for every registered query (the correctness oracle).

Tables ``events`` and ``orders`` are pre-registered views. Each statement
re-derives its result from the raw tables with plain window functions over
whole series (fine for a single-node oracle) and rounds doubles like the
Spark side.
"""

from __future__ import annotations

from sigmaflow.config import DAILY_PARAMS, TICK_PARAMS


def _ts(v) -> str:
    return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S}'"


def _day(v) -> str:
    return f"TIMESTAMP '{v:%Y-%m-%d} 00:00:00'"


def R(col: str, digits: int = 6, alias: str | None = None) -> str:
    return f"round({col}, {digits}) AS {alias or col}"


T0, T1, TO = _ts(TICK_PARAMS.start), _ts(TICK_PARAMS.end), _day(TICK_PARAMS.origin_day)
DO = _day(DAILY_PARAMS.origin_day)

TICKS = f"""ticks AS (
  SELECT event_type AS series, ts AS date, value AS adjusted, event_id AS tick_id
  FROM events WHERE (value IS NULL OR value > 0))"""

TICKS_IN_RANGE = TICKS.replace("(value IS NULL OR value > 0)", f"(value IS NULL OR value > 0) AND ts BETWEEN {T0} AND {T1}")

BARS = """bars AS (
  SELECT series, time_bucket(INTERVAL '5 minutes', date) AS bar,
         min(date) AS date, arg_min(adjusted, date) AS adjusted
  FROM ticks GROUP BY 1, 2)"""

RET5 = """ret5 AS (
  SELECT series, bar, day, date, adjusted, "return" FROM (
    SELECT series, bar, date, adjusted, CAST(CAST(date AS DATE) AS TIMESTAMP) AS day,
           ln(adjusted) - ln(lag(adjusted) OVER (PARTITION BY series ORDER BY date)) AS "return",
           row_number() OVER (PARTITION BY series ORDER BY date) AS rn
    FROM bars) WHERE rn > 1)"""

# daily returns from the last tick of each day
DRET = """dclose AS (
  SELECT series, CAST(CAST(date AS DATE) AS TIMESTAMP) AS day,
         max(date) AS date, arg_max(adjusted, date) AS adjusted
  FROM ticks GROUP BY 1, 2),
dret AS (
  SELECT series, day, date, adjusted, "return" FROM (
    SELECT *, ln(adjusted) - ln(lag(adjusted) OVER (PARTITION BY series ORDER BY day)) AS "return",
           row_number() OVER (PARTITION BY series ORDER BY day) AS rn
    FROM dclose) WHERE rn > 1)"""

ORDERS_DRET = f"""oprices AS (
  SELECT o_orderpriority AS series, o_orderdate AS date, o_totalprice AS adjusted, o_orderkey AS tick_id
  FROM orders WHERE (o_totalprice IS NULL OR o_totalprice > 0)),
oclose AS (
  SELECT series, CAST(CAST(date AS DATE) AS TIMESTAMP) AS day,
         max(date) AS date, arg_max(adjusted, (date, tick_id)) AS adjusted
  FROM oprices GROUP BY 1, 2),
oret AS (
  SELECT series, day, date, adjusted, "return" FROM (
    SELECT *, ln(adjusted) - ln(lag(adjusted) OVER (PARTITION BY series ORDER BY day)) AS "return",
           row_number() OVER (PARTITION BY series ORDER BY day) AS rn
    FROM oclose) WHERE rn > 1)"""

OUTLIER = """ostats AS (
  SELECT series, median("return") AS median, stddev_samp("return") AS sd, count("return") AS n_obs
  FROM ret5 GROUP BY 1),
ret5f AS (
  SELECT r.series, r.bar, r.day, r.date, r.adjusted,
         CASE WHEN NOT ("return" BETWEEN s.median - 5 * s.sd AND s.median + 5 * s.sd)
              THEN s.median ELSE "return" END AS "return"
  FROM ret5 r LEFT JOIN ostats s USING (series))"""

RV = f"""rv AS (
  SELECT series, day, max(date) AS date, sum("return" * "return") AS realized_variance
  FROM ret5 WHERE day > {TO} GROUP BY 1, 2),
sq AS (
  SELECT series, day, time_bucket(INTERVAL '5 minutes', date) AS date, "return" * "return" AS squared_return
  FROM dret WHERE day > {TO})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["clean_prices"] = with_(TICKS_IN_RANGE) + "SELECT series, date, round(adjusted, 6) AS adjusted FROM ticks"
# the raw layout holds whole epoch seconds
SQL["scan_csv_roundtrip"] = with_(TICKS) + (
    "SELECT series, date_trunc('second', date) AS date, round(adjusted, 6) AS adjusted FROM ticks "
    f"WHERE date_trunc('second', date) BETWEEN {T0} AND {T1}")
SQL["scan_cleaned_csv_roundtrip"] = with_(TICKS) + "SELECT series, date, round(adjusted, 6) AS adjusted FROM ticks"
SQL["resample_5min"] = with_(TICKS, BARS) + "SELECT series, bar, date, round(adjusted, 6) AS adjusted FROM bars"
SQL["scan_parquet_roundtrip"] = SQL["resample_5min"]
SQL["daily_close"] = with_(TICKS, BARS) + """SELECT series, CAST(CAST(date AS DATE) AS TIMESTAMP) AS day,
  max(date) AS date, round(arg_max(adjusted, date), 6) AS adjusted FROM bars GROUP BY 1, 2"""
SQL["log_returns_5min"] = with_(TICKS, BARS, RET5) + (
    f"SELECT series, bar, day, date, {R('adjusted')}, {R('\"return\"', alias='\"return\"')} FROM ret5")
SQL["log_returns_daily"] = with_(TICKS, DRET) + (
    f"SELECT series, day, date, {R('adjusted')}, {R('\"return\"', alias='\"return\"')} FROM dret")
SQL["log_returns_daily_orders"] = with_(ORDERS_DRET) + (
    f"SELECT series, day, date, {R('adjusted')}, {R('\"return\"', alias='\"return\"')} FROM oret")
SQL["collapse_to_daily"] = with_(TICKS, BARS, RET5) + """SELECT series, bar,
  max(date) OVER (PARTITION BY series, day) AS date, round("return", 6) AS "return" FROM ret5"""
SQL["floor_5min"] = with_(TICKS, DRET) + """SELECT series, day,
  time_bucket(INTERVAL '5 minutes', date) AS date, round("return", 6) AS "return" FROM dret"""
SQL["outlier_stats"] = with_(TICKS, BARS, RET5, OUTLIER) + f"""SELECT series, {R('median')}, {R('sd')},
  n_obs, {R('median - 5 * sd', alias='lower')}, {R('median + 5 * sd', alias='upper')} FROM ostats"""
SQL["outlier_replace"] = with_(TICKS, BARS, RET5, OUTLIER) + (
    'SELECT series, date, round("return", 6) AS "return" FROM ret5f')
SQL["oos_count"] = with_(TICKS, BARS, RET5) + f"""SELECT series,
  count(*) FILTER (WHERE day > {TO}) AS n_out_sample,
  count(*) FILTER (WHERE day <= {TO}) AS n_in_sample FROM ret5 GROUP BY 1"""
SQL["oos_strict"] = with_(TICKS, BARS, RET5) + (
    f"""SELECT series, day, date, {R('"return"', alias='"return"')} FROM ret5 WHERE date > {_ts(TICK_PARAMS.forecast_start)}""")
SQL["realized_variance"] = with_(TICKS, BARS, RET5, DRET, RV) + (
    f"SELECT series, day, date, {R('realized_variance')} FROM rv")
SQL["squared_daily_return"] = with_(TICKS, BARS, RET5, DRET, RV) + (
    f"SELECT series, day, date, {R('squared_return')} FROM sq")
PROXY_LONG = """plong AS (
  SELECT rv.series, rv.day, rv.date, 'Realized Variance' AS proxy, rv.realized_variance AS value FROM rv
  UNION ALL
  SELECT rv.series, rv.day, rv.date, 'Squared Return' AS proxy, sq.squared_return AS value
  FROM rv LEFT JOIN sq USING (series, day))"""
SQL["proxy_compare"] = with_(TICKS, BARS, RET5, DRET, RV, PROXY_LONG) + (
    f"SELECT series, day, date, proxy, {R('value')} FROM plong")
SQL["proxy_noise"] = with_(TICKS, BARS, RET5, DRET, RV, PROXY_LONG) + (
    f"SELECT series, proxy, {R('stddev_samp(value)', alias='sd')}, count(value) AS n_obs FROM plong GROUP BY 1, 2")
SQL["returns_union"] = with_(TICKS, BARS, RET5) + """, dbar AS (
  SELECT series, CAST(CAST(date AS DATE) AS TIMESTAMP) AS day, max(date) AS date,
         arg_max(adjusted, date) AS adjusted FROM bars GROUP BY 1, 2),
dbret AS (
  SELECT series, date, adjusted, "return" FROM (
    SELECT *, ln(adjusted) - ln(lag(adjusted) OVER (PARTITION BY series ORDER BY day)) AS "return",
           row_number() OVER (PARTITION BY series ORDER BY day) AS rn FROM dbar) WHERE rn > 1),
allr AS (
  SELECT series, '5 Minute' AS type, date, adjusted, "return" FROM ret5
  UNION ALL SELECT series, 'Daily' AS type, date, adjusted, "return" FROM dbret)
SELECT series, type, date, round(adjusted, 6) AS adjusted, round("return", 6) AS "return",
  round("return" * "return", 6) AS squared_return, round(abs("return"), 6) AS abs_return FROM allr"""

# ---------------------------------------------------------------- evaluation
from sigmaflow.functions.stats import normal_two_sided_sql, significant_sql, t_tail_sql  # noqa: E402
from sigmaflow.plans.evaluation import (  # noqa: E402
    DIST_LABELS,
    FILTER_LABELS,
    METRIC_LABELS,
    STD_ERROR_METRICS,
    STYLE_LABELS_NORMAL,
)

EXCL = _day(TICK_PARAMS.excluded_day)

NAIVE = f"""rv_all AS (
  SELECT series, day, sum("return" * "return") AS realized_variance FROM ret5 GROUP BY 1, 2),
rvf_all AS (
  SELECT series, day, sum("return" * "return") AS realized_variance FROM ret5f GROUP BY 1, 2),
nb AS (
  SELECT series, day,
    lag(realized_variance) OVER (PARTITION BY series ORDER BY day) AS f5,
    CASE WHEN count(realized_variance) OVER (PARTITION BY series ORDER BY day
                                            ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5
         THEN avg(realized_variance) OVER (PARTITION BY series ORDER BY day
                                           ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS fd
  FROM rv_all),
nbf AS (
  SELECT series, day, lag(realized_variance) OVER (PARTITION BY series ORDER BY day) AS ff FROM rvf_all),
nf AS (
  SELECT series, day, '5min' AS forc_style, f5 AS v FROM nb
  UNION ALL SELECT series, day, 'daily' AS forc_style, fd AS v FROM nb
  UNION ALL SELECT series, day, '5min_filtered' AS forc_style, ff AS v FROM nbf),
fc AS (
  SELECT series, d.distribution, forc_style, day,
         CASE WHEN d.distribution = 'Student-t' THEN v * CAST(1.1 AS DOUBLE) ELSE v END
           AS daily_variance_forecast
  FROM nf CROSS JOIN (VALUES ('Normal'), ('Student-t')) d(distribution)
  WHERE v IS NOT NULL AND day > {TO})"""

PERF = f"""perf2 AS (
  SELECT f.series, f.distribution, f.forc_style, f.day, f.daily_variance_forecast,
         rv.realized_variance, sq.squared_return
  FROM fc f LEFT JOIN rv ON f.series = rv.series AND f.day = rv.day
            LEFT JOIN sq ON f.series = sq.series AND f.day = sq.day
  WHERE f.forc_style IN ('5min', 'daily')),
perf AS (
  SELECT * FROM perf2
  UNION ALL BY NAME
  SELECT * REPLACE ('5min_no_outlier' AS forc_style) FROM perf2
  WHERE forc_style = '5min' AND day <> {EXCL}),
perf3 AS (
  SELECT f.series, f.distribution, f.forc_style, f.day, f.daily_variance_forecast,
         rv.realized_variance, sq.squared_return
  FROM fc f LEFT JOIN rv ON f.series = rv.series AND f.day = rv.day
            LEFT JOIN sq ON f.series = sq.series AND f.day = sq.day
  WHERE f.forc_style IN ('5min', '5min_filtered', 'daily'))"""

EVAL_BASE = (TICKS, BARS, RET5, DRET, RV, OUTLIER, NAIVE, PERF)
GRP = "series, distribution, forc_style"

SQL["naive_all_forecasts"] = with_(*EVAL_BASE) + (
    f"SELECT {GRP}, day, {R('daily_variance_forecast')} FROM fc")
SQL["naive_performance_data"] = with_(*EVAL_BASE) + f"""SELECT {GRP}, day, {R('daily_variance_forecast')},
  {R('realized_variance')}, {R('squared_return')} FROM perf"""
SQL["naive_performance_data_filtered"] = with_(*EVAL_BASE) + f"""SELECT {GRP}, day,
  {R('daily_variance_forecast')}, {R('realized_variance')}, {R('squared_return')} FROM perf3"""


def _compare_sql(where: str, key: str, keep: str, values: list[str], labels: dict[str, str], ctes: tuple = EVAL_BASE) -> str:
    base = f"""cmp AS (
  SELECT f.series, f.day, f.{keep}, f.{key} AS k, f.daily_variance_forecast AS v, rv.realized_variance
  FROM fc f LEFT JOIN rv ON f.series = rv.series AND f.day = rv.day WHERE {where}),
wide AS (
  SELECT series, day, {keep}, realized_variance,
    {", ".join(f"first(v) FILTER (WHERE k = '{v}') AS \"{v}\"" for v in values)}
  FROM cmp GROUP BY series, day, {keep}, realized_variance),
lng AS (
  {" UNION ALL ".join(f"SELECT series, day, {keep}, '{v}' AS metric, \"{v}\" AS variance_estimate FROM wide" for v in values)}
  UNION ALL SELECT series, day, {keep}, 'realized_variance' AS metric, realized_variance AS variance_estimate FROM wide)"""
    case = "CASE metric " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in labels.items()) + " ELSE metric END"
    return with_(*ctes, base) + (
        f"SELECT series, day, {keep}, {case} AS metric, {R('variance_estimate')} FROM lng")


COMPARE = {
    "compare_styles_long": ("f.distribution = 'Normal' AND f.forc_style IN ('5min', 'daily')", "forc_style", "distribution",
                            ["5min", "daily"], STYLE_LABELS_NORMAL),
    "compare_dists_long": ("f.forc_style = '5min'", "distribution", "forc_style", ["Normal", "Student-t"], DIST_LABELS),
    "compare_filtered_long": ("f.distribution = 'Normal' AND f.forc_style IN ('5min', '5min_filtered')", "forc_style", "distribution",
                              ["5min", "5min_filtered"], FILTER_LABELS),
}
for _name, _args in COMPARE.items():
    SQL[f"naive_{_name}"] = _compare_sql(*_args)


def _metrics_sql(src: str, proxy: str) -> str:
    e = f"({proxy} - daily_variance_forecast)"
    return with_(*EVAL_BASE) + f"""SELECT {GRP},
  {R(f'avg({e} * {e})', alias='mse')}, {R(f'sqrt(avg({e} * {e}))', alias='rmse')},
  {R(f'avg(abs({e}))', alias='mae')}, {R(f'avg(abs({e}) / nullif(sqrt({proxy}), 0))', alias='mape')},
  count({e}) AS n_obs, count(*) FILTER (WHERE {proxy} IS NULL) AS n_missing,
  count(*) FILTER (WHERE {proxy} = 0 AND daily_variance_forecast IS NOT NULL) AS n_zero_proxy
FROM {src} GROUP BY {GRP}"""


SQL["naive_error_metrics_rv"] = _metrics_sql("perf3", "realized_variance")
SQL["naive_error_metrics_sqret"] = _metrics_sql("perf3", "squared_return")


def _ols_cte(src: str, y: str, x: str, group: str) -> str:
    return f"""ols AS (
  SELECT {group}, regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope,
         regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r_squared,
         regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy,
         regr_avgx({y}, {x}) AS avgx
  FROM {src} GROUP BY {group}),
ols2 AS (
  SELECT *, syy - sxy * sxy / nullif(sxx, 0) AS sse FROM ols),
ols3 AS (
  SELECT *, sse / nullif(n - 2, 0) AS sigma2 FROM ols2),
ols4 AS (
  SELECT *, sqrt(sigma2 / nullif(sxx, 0)) AS se_slope,
         sqrt(sigma2 * (1.0 / nullif(n, 0) + avgx * avgx / nullif(sxx, 0))) AS se_intercept,
         n - 2 AS df_residual FROM ols3)"""


def _tidy_sql(src: str, y: str, group: str = GRP, extra: tuple[str, ...] = EVAL_BASE) -> str:
    p = t_tail_sql("statistic", "df_residual", "duckdb")
    return with_(*extra, _ols_cte(src, y, "daily_variance_forecast", group)) + f""", terms AS (
  SELECT {group}, df_residual, '(Intercept)' AS term, intercept AS estimate, se_intercept AS std_error FROM ols4
  UNION ALL
  SELECT {group}, df_residual, 'daily_variance_forecast' AS term, slope AS estimate, se_slope AS std_error FROM ols4),
t2 AS (SELECT *, estimate / nullif(std_error, 0) AS statistic FROM terms)
SELECT {group}, term, {R('estimate')}, {R('std_error')}, {R('statistic')}, {R(p, alias='p_value')} FROM t2"""


def _glance_sql(src: str, y: str, group: str = GRP, extra: tuple[str, ...] = EVAL_BASE) -> str:
    p = t_tail_sql("t_slope", "df_residual", "duckdb")
    ll = "(-CAST(n AS DOUBLE) / 2 * (ln(2 * pi()) + ln(sse / n) + 1))"
    return with_(*extra, _ols_cte(src, y, "daily_variance_forecast", group)) + f""", g AS (
  SELECT *, slope / nullif(se_slope, 0) AS t_slope FROM ols4)
SELECT {group}, {R('r_squared')},
  {R('1 - (1 - r_squared) * (n - 1) / nullif(n - 2, 0)', alias='adj_r_squared')},
  {R('sqrt(sigma2)', alias='sigma')}, {R('t_slope * t_slope', alias='statistic')},
  {R(p, alias='p_value')}, CAST(1 AS BIGINT) AS df, {R(ll, alias='loglik')},
  {R(f'-2 * {ll} + 6', alias='aic')}, {R(f'-2 * {ll} + 3 * ln(n)', alias='bic')},
  {R('sse', alias='deviance')}, df_residual, n AS nobs FROM g"""


SQL["naive_mz_tidy_rv"] = _tidy_sql("perf3", "realized_variance")
SQL["naive_mz_tidy_sqret"] = _tidy_sql("perf3", "squared_return")
SQL["naive_mz_glance_rv"] = _glance_sql("perf3", "realized_variance")
SQL["naive_mz_glance_sqret"] = _glance_sql("perf3", "squared_return")

METRIC_ROWS = [(k, i + 1, v) for i, (k, v) in enumerate(METRIC_LABELS.items())]


def _result_sql(src: str, styles: dict[str, str], display: bool = False, base: tuple = EVAL_BASE) -> str:
    grp = "series, forc_style, proxy"
    long = f"""lp AS (
  SELECT series, forc_style, day, daily_variance_forecast, 'realized_variance' AS proxy,
         realized_variance AS variance_proxy FROM {src} WHERE distribution = 'Normal'
  UNION ALL
  SELECT series, forc_style, day, daily_variance_forecast, 'squared_return' AS proxy,
         squared_return AS variance_proxy FROM {src} WHERE distribution = 'Normal')"""
    e = "(variance_proxy - daily_variance_forecast)"
    body = with_(*base, long, _ols_cte("lp", "variance_proxy", "daily_variance_forecast", grp)) + f""",
em AS (
  SELECT {grp}, sqrt(avg({e} * {e})) AS rmse, avg(abs({e}) / nullif(sqrt(variance_proxy), 0)) AS mape
  FROM lp GROUP BY {grp}),
ml AS (
  SELECT {grp}, 'mape' AS metric, mape AS value FROM em
  UNION ALL SELECT {grp}, 'rmse', rmse FROM em
  UNION ALL SELECT {grp}, '(Intercept)_estimate', intercept FROM ols4
  UNION ALL SELECT {grp}, '(Intercept)_std.error', se_intercept FROM ols4
  UNION ALL SELECT {grp}, 'daily_variance_forecast_estimate', slope FROM ols4
  UNION ALL SELECT {grp}, 'daily_variance_forecast_std.error', se_slope FROM ols4
  UNION ALL SELECT {grp}, 'r.squared', r_squared FROM ols4),
mr(metric, metric_rank, label) AS (VALUES {", ".join(f"('{a}', {b}, '{c}')" for a, b, c in METRIC_ROWS)}),
tab AS (
  SELECT series, proxy, CAST(metric_rank AS BIGINT) AS metric_rank, label AS metric,
    {", ".join(f"first(value) FILTER (WHERE forc_style = '{k}') AS {v}" for k, v in styles.items())}
  FROM ml JOIN mr USING (metric) WHERE forc_style IN ({", ".join(f"'{k}'" for k in styles)})
  GROUP BY series, proxy, metric_rank, label)
"""
    if not display:
        return body + f"SELECT series, proxy, metric_rank, metric, {', '.join(R(v) for v in styles.values())} FROM tab"
    se = "metric IN (" + ", ".join(f"'{m}'" for m in STD_ERROR_METRICS) + ")"
    cols = ", ".join(
        f"CASE WHEN {v} IS NULL THEN NULL WHEN {se} THEN printf('(%.5f)', round({v}, 5)) "
        f"ELSE printf('%.5f', round({v}, 5)) END AS {v}" for v in styles.values())
    return body + f"SELECT series, proxy, metric_rank, CASE WHEN {se} THEN NULL ELSE metric END AS metric, {cols} FROM tab"


_MAIN = {"5min": "five_min", "daily": "daily", "5min_no_outlier": "five_min_no_outlier"}
SQL["naive_result_table"] = _result_sql("perf", _MAIN)
SQL["naive_result_table_filtered"] = _result_sql("perf3", {"5min_filtered": "five_min_filtered"})
SQL["naive_result_table_display"] = _result_sql("perf", _MAIN, display=True)

# ---------------------------------------------------------------- ACF
DBRET = """dbar AS (
  SELECT series, CAST(CAST(date AS DATE) AS TIMESTAMP) AS day, max(date) AS date,
         arg_max(adjusted, date) AS adjusted FROM bars GROUP BY 1, 2),
dbret AS (
  SELECT series, date, adjusted, "return" FROM (
    SELECT *, ln(adjusted) - ln(lag(adjusted) OVER (PARTITION BY series ORDER BY day)) AS "return",
           row_number() OVER (PARTITION BY series ORDER BY day) AS rn FROM dbar) WHERE rn > 1)"""


def _acf_sql(transform: str) -> str:
    f = {"returns": '"return"', "squared": '"return" * "return"', "absolute": 'abs("return")'}[transform]
    return with_(TICKS, BARS, RET5, DBRET) + f""", xs AS (
  SELECT series, '5min' AS sampling, date, {f} AS x FROM ret5
  UNION ALL SELECT series, 'daily' AS sampling, date, {f} AS x FROM dbret),
ix AS (
  SELECT series, sampling, x, row_number() OVER (PARTITION BY series, sampling ORDER BY date) AS i,
         count(*) OVER (PARTITION BY series, sampling) AS n,
         avg(x) OVER (PARTITION BY series, sampling) AS m FROM xs WHERE x IS NOT NULL),
st AS (
  SELECT DISTINCT series, sampling, n, CAST(least(floor(10 * log10(n)), n - 1) AS BIGINT) AS kmax FROM ix),
lags AS (SELECT series, sampling, n, kmax, unnest(range(0, kmax + 1)) AS k FROM st),
pr AS (
  SELECT l.series, l.sampling, l.k, l.n, sum((a.x - a.m) * (b.x - b.m)) AS ck
  FROM lags l JOIN ix a ON a.series = l.series AND a.sampling = l.sampling
  JOIN ix b ON b.series = a.series AND b.sampling = a.sampling AND b.i = a.i + l.k
  GROUP BY 1, 2, 3, 4)
SELECT p.series, p.sampling, '{transform}' AS transform, CAST(p.k AS BIGINT) AS lag,
  round(p.ck / z.ck, 6) AS acf, CAST(p.n AS BIGINT) AS n, round(1.959963984540054 / sqrt(p.n), 6) AS ci
FROM pr p JOIN pr z ON z.series = p.series AND z.sampling = p.sampling AND z.k = 0"""


for _t in ("returns", "squared", "absolute"):
    SQL[f"acf_{_t}"] = _acf_sql(_t)

# ---------------------------------------------------------------- windows and GARCH
import math  # noqa: E402

from sigmaflow.config import DEFAULT_GRID, GUARD_GRID  # noqa: E402

EPOCH_TS = "TIMESTAMP '1970-01-01 00:00:00'"


def _days(src: str, origin: str, px: str = "") -> str:
    return f"""{px}days AS (
  SELECT series, day, max(date) AS day_end, count(*) AS n_rows,
         row_number() OVER (PARTITION BY series ORDER BY day) AS day_idx,
         sum(count(*)) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING) AS cum_rows
  FROM {src} GROUP BY series, day),
{px}org AS (SELECT series, min(day_idx) AS o FROM {px}days WHERE day >= {origin} GROUP BY series),
{px}win AS (
  SELECT d.series, d.day_idx - g.o AS window_id, d.day_idx - g.o AS fit_first_idx,
         d.day_idx - 1 AS fit_last_idx, d.day_idx AS target_idx, d.day AS target_day,
         d.day_end AS hi, d.n_rows AS n_ahead
  FROM {px}days d JOIN {px}org g USING (series) WHERE d.day_idx > g.o),
{px}windows AS (
  SELECT w.*, f.day AS fit_first_day, l.day AS fit_last_day, coalesce(b.day_end, {EPOCH_TS}) AS lo,
         l.day_end AS fit_hi, CAST(l.cum_rows - (f.cum_rows - f.n_rows) AS BIGINT) AS n_fit
  FROM {px}win w JOIN {px}days f ON f.series = w.series AND f.day_idx = w.fit_first_idx
  LEFT JOIN {px}days b ON b.series = w.series AND b.day_idx = w.fit_first_idx - 1
  JOIN {px}days l ON l.series = w.series AND l.day_idx = w.fit_last_idx)"""


def _grid_cte(distributions=("Normal", "Student-t")) -> str:
    rows = []
    for d in distributions:
        for a, p, nu in DEFAULT_GRID.points(d):
            nu_s = "CAST(NULL AS DOUBLE)" if nu is None else f"CAST({nu!r} AS DOUBLE)"
            rows.append(f"('{d}', CAST({a!r} AS DOUBLE), CAST({p!r} AS DOUBLE), CAST({p - a!r} AS DOUBLE), {nu_s})")
    return ("grid0(distribution, alpha, persistence, beta, nu) AS (VALUES " + ", ".join(rows) + "),\n"
            "grid AS (SELECT *, lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(pi() * (nu - 2)) AS c_nu FROM grid0)")


LN2PI = repr(math.log(2 * math.pi))
LL_SQL = (
    "list_reduce(s.r, lambda st, x: {'h': g.alpha * x * x + g.beta * st.h, 'll': st.ll + "
    f"CASE WHEN g.distribution = 'Normal' THEN -0.5 * ({LN2PI} + ln(st.h) + x * x / st.h) "
    "ELSE g.c_nu - 0.5 * ln(st.h) - (g.nu + 1) / 2 * ln(1 + x * x / (st.h * (g.nu - 2))) END}, "
    "{'h': list_reduce(s.r, lambda acc, x: acc + x * x, CAST(0 AS DOUBLE)) / len(s.r), 'll': CAST(0 AS DOUBLE)})")

def _lls(px: str = "") -> str:
    return f"""{px}lls AS (
  SELECT s.series, s.window_id, g.distribution, g.alpha, g.persistence, g.beta, g.nu,
         CAST(len(s.r) AS BIGINT) AS n_obs, {LL_SQL} AS fit
  FROM {px}samples s CROSS JOIN grid g),
{px}best AS (
  SELECT series, window_id, distribution,
         arg_max({{'alpha': alpha, 'persistence': persistence, 'beta': beta, 'nu': nu,
                   'loglik': fit.ll, 'h_next': fit.h, 'n_obs': n_obs}},
                 (round(fit.ll, 7), -alpha, -persistence, -coalesce(nu, 0))) AS b
  FROM {px}lls GROUP BY 1, 2, 3),
{px}fits AS (
  SELECT series, window_id, distribution, b.alpha AS alpha, b.persistence AS persistence, b.beta AS beta,
         b.nu AS nu, b.loglik AS loglik, b.h_next AS h_next, b.n_obs AS n_obs FROM {px}best)"""


LLS = _lls()

DAILY_VAR = ("list_reduce(range(1, n_ahead + 1), lambda acc, k: acc + pow(sqrt(h_next * pow(persistence, k - 1)), 2), "
             "CAST(0 AS DOUBLE))")

INTRA = (TICKS, BARS, RET5)
DAILY = (ORDERS_DRET,)

SQL["day_ends"] = with_(*INTRA) + """, d AS (
  SELECT series, max(date) AS day_end, CAST(row_number() OVER (PARTITION BY series ORDER BY day) AS BIGINT) AS day_idx
  FROM ret5 GROUP BY series, day)
SELECT series, day_idx, day_end FROM d
UNION ALL SELECT DISTINCT series, CAST(0 AS BIGINT) AS day_idx, TIMESTAMP '1970-01-01 00:00:00' AS day_end FROM ret5"""

WIN_COLS = ("series, CAST(window_id AS BIGINT) AS window_id, CAST(fit_first_idx AS BIGINT) AS fit_first_idx, "
            "CAST(fit_last_idx AS BIGINT) AS fit_last_idx, CAST(target_idx AS BIGINT) AS target_idx, "
            "fit_first_day, fit_last_day, target_day, lo, fit_hi, hi, n_fit, CAST(n_ahead AS BIGINT) AS n_ahead")
SQL["rolling_windows"] = with_(*INTRA, _days("ret5", TO)) + f"SELECT {WIN_COLS} FROM windows"
SQL["forecast_horizon"] = with_(*INTRA, _days("ret5", TO)) + (
    "SELECT series, CAST(window_id AS BIGINT) AS window_id, target_day, CAST(n_ahead AS BIGINT) AS n_ahead FROM windows")
SQL["window_rows"] = with_(*INTRA, _days("ret5", TO)) + """SELECT w.series, CAST(w.window_id AS BIGINT) AS window_id,
  count(*) AS n_rows, round(sum(r."return" * r."return"), 6) AS sum_sq
FROM windows w JOIN ret5 r ON r.series = w.series AND r.date > w.lo AND r.date <= w.fit_hi
GROUP BY 1, 2"""


def _in_sample(src: str, origin: str) -> str:
    return f"""samples AS (
  SELECT series, 0 AS window_id, list("return" ORDER BY date) AS r FROM {src}
  WHERE day <= {origin} GROUP BY series),
nextday AS (
  SELECT series, arg_min(day, day) AS target_day, arg_min(n, day) AS n_ahead FROM (
    SELECT series, day, count(*) AS n FROM {src} WHERE day > {origin} GROUP BY 1, 2) GROUP BY 1)"""


def _ll_table_sql(dist: str) -> str:
    return with_(*DAILY, _in_sample("oret", DO), _grid_cte((dist,)), LLS) + """SELECT series, distribution,
  round(alpha, 4) AS alpha, round(persistence, 4) AS persistence, round(beta, 4) AS beta, round(nu, 4) AS nu,
  round(fit.ll, 4) AS loglik, round(fit.h, 4) AS h_next, n_obs FROM lls"""


SQL["garch_loglik_normal"] = _ll_table_sql("Normal")
SQL["garch_loglik_t"] = _ll_table_sql("Student-t")

FIT_COLS = ("f.series, f.distribution, round(f.alpha, {d}) AS alpha, round(f.persistence, {d}) AS persistence, "
            "round(f.beta, {d}) AS beta, round(f.nu, {d}) AS nu, round(f.loglik, {d}) AS loglik, "
            "round(f.h_next, {d}) AS h_next, f.n_obs")
SQL["garch_grid_fit"] = with_(*DAILY, _in_sample("oret", DO), _grid_cte(), LLS) + (
    f"SELECT {FIT_COLS.format(d=4)}, n.target_day, CAST(n.n_ahead AS BIGINT) AS n_ahead "
    "FROM fits f JOIN nextday n USING (series)")
SQL["garch_grid_fit_5min"] = with_(*INTRA, _in_sample("ret5", TO), _grid_cte(), LLS) + (
    f"SELECT {FIT_COLS.format(d=4)}, n.target_day, CAST(n.n_ahead AS BIGINT) AS n_ahead "
    "FROM fits f JOIN nextday n USING (series)")
SQL["garch_nstep_forecast"] = with_(*INTRA, _in_sample("ret5", TO), _grid_cte(), LLS) + """, steps AS (
  SELECT f.series, f.distribution, n.target_day AS day, f.h_next, f.persistence,
         unnest(range(1, n.n_ahead + 1)) AS step
  FROM fits f JOIN nextday n USING (series))
SELECT series, distribution, day, CAST(step AS BIGINT) AS step,
  round(sqrt(h_next * pow(persistence, step - 1)), 6) AS sigma FROM steps"""
SQL["garch_daily_variance"] = with_(*INTRA, _in_sample("ret5", TO), _grid_cte(), LLS) + f"""SELECT f.series,
  f.distribution, n.target_day AS day,
  round(list_reduce(range(1, n.n_ahead + 1), lambda acc, k: acc + pow(sqrt(f.h_next * pow(f.persistence, k - 1)), 2),
                    CAST(0 AS DOUBLE)), 6) AS daily_variance_forecast
FROM fits f JOIN nextday n USING (series)"""


def _roll_ctes(src: str, origin: str, style: str, px: str) -> tuple[str, ...]:
    samples = f"""{px}samples AS (
  SELECT w.series, w.window_id, list(r."return" ORDER BY r.date) AS r
  FROM {px}windows w JOIN {src} r ON r.series = w.series AND r.day >= w.fit_first_day AND r.day <= w.fit_last_day
  GROUP BY 1, 2)"""
    fc = f"""{px}fc AS (
  SELECT series, distribution, '{style}' AS forc_style, target_day AS day, window_id, alpha, beta,
         nu, loglik, {DAILY_VAR} AS daily_variance_forecast
  FROM (SELECT f.*, w.n_ahead, w.target_day FROM {px}fits f JOIN {px}windows w USING (series, window_id)))"""
    return _days(src, origin, px), samples, _lls(px), fc


def _roll_sql(base: tuple[str, ...], src: str, origin: str, style: str, refined: bool = False) -> str:
    ctes = _roll_ctes(src, origin, style, "")
    start = with_(*base, _grid_cte(), *(_roll_mle(ctes, "") if refined else ctes))
    return (start.replace("WITH ", "WITH RECURSIVE ", 1) if refined else start) + """SELECT series, distribution,
  forc_style, day, CAST(window_id AS BIGINT) AS window_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta,
  round(nu, 6) AS nu, round(loglik, 4) AS loglik, round(daily_variance_forecast, 6) AS daily_variance_forecast
FROM fc"""


SQL["garch_roll_daily_grid"] = _roll_sql(DAILY, "oret", DO, "daily")
SQL["garch_roll_intraday_grid"] = _roll_sql(INTRA, "ret5", TO, "5min")
SQL["garch_roll_filtered_grid"] = _roll_sql(INTRA + (OUTLIER,), "ret5f", TO, "5min_filtered")


# GARCH forecasts of the three styles evaluated against the proxies (the full pipeline)
GARCH_FC = (_grid_cte(),) + _roll_ctes("ret5", TO, "5min", "a_") + _roll_ctes("ret5f", TO, "5min_filtered", "b_") \
    + _roll_ctes("dret", TO, "daily", "c_") + ("""fc AS (
  SELECT series, distribution, forc_style, day, daily_variance_forecast FROM a_fc
  UNION ALL SELECT series, distribution, forc_style, day, daily_variance_forecast FROM b_fc
  UNION ALL SELECT series, distribution, forc_style, day, daily_variance_forecast FROM c_fc)""",)
GARCH_BASE = (TICKS, BARS, RET5, DRET, RV, OUTLIER) + GARCH_FC + (PERF,)

SQL["garch_all_forecasts"] = with_(*GARCH_BASE) + f"SELECT {GRP}, day, {R('daily_variance_forecast')} FROM fc"
SQL["garch_performance_data"] = with_(*GARCH_BASE) + f"""SELECT {GRP}, day, {R('daily_variance_forecast')},
  {R('realized_variance')}, {R('squared_return')} FROM perf"""
SQL["garch_performance_data_filtered"] = with_(*GARCH_BASE) + f"""SELECT {GRP}, day,
  {R('daily_variance_forecast')}, {R('realized_variance')}, {R('squared_return')} FROM perf3"""
SQL["garch_result_table"] = _result_sql("perf", _MAIN, base=GARCH_BASE)
SQL["garch_result_table_filtered"] = _result_sql("perf3", {"5min_filtered": "five_min_filtered"}, base=GARCH_BASE)
for _name, _args in COMPARE.items():
    SQL[f"garch_{_name}"] = _compare_sql(*_args, ctes=GARCH_BASE)
# ---- refined fits: the same search, one round per step of the recursion


def _ll_of(r: str, h1: str, dist: str, a: str, b: str, nu: str) -> str:
    """Likelihood and next variance of one parameter point."""
    c = f"(lgamma(({nu} + 1) / 2) - lgamma({nu} / 2) - 0.5 * ln(pi() * ({nu} - 2)))"
    return (f"list_reduce({r}, lambda st, x: {{'h': {a} * x * x + {b} * st.h, 'll': st.ll + CASE WHEN {dist} = 'Normal' "
            f"THEN -0.5 * ({LN2PI} + ln(st.h) + x * x / st.h) ELSE -0.5 * ln(st.h) - ({nu} + 1) / 2 * ln(1 + x * x / (st.h * ({nu} - 2))) END}}, "
            f"{{'h': {h1}, 'll': CASE WHEN {dist} = 'Normal' THEN CAST(0 AS DOUBLE) ELSE len({r}) * {c} END}})")


def _refined(px: str = "") -> str:
    """CTE ``{px}mle``: the refined fit of every grid fit. A search of shrinking spacing finds the top's
    neighbourhood, and a few Newton steps with exact derivatives end on it."""
    clip_a = "greatest(least(alpha + o.a * 0.02 / pow(2, halved), 0.999), 0)"
    clip_p = "greatest(least(persistence + o.p * 0.02 / pow(2, halved), 0.999), 0)"
    clip_n = "CASE WHEN nu IS NULL THEN NULL ELSE greatest(least(nu + o.n * 2.0 / pow(2, halved), 100.0), 2.1) END"
    ll = _ll_of("r", "h1", "distribution", "t.a", "(t.p - t.a)", "coalesce(t.n, 10.0)")
    guard = ", ".join(f"('{d}', {a!r}::DOUBLE, {p!r}::DOUBLE, {'NULL' if n is None else n}::DOUBLE, {GUARD_GRID.alphas.index(a)}, {GUARD_GRID.persistences.index(p)}, "
                      f"{0 if n is None else GUARD_GRID.nus.index(n)})" for d in ("Normal", "Student-t") for a, p, n in GUARD_GRID.points(d))
    return f"""{px}guard(distribution, alpha, persistence, nu, ia, ip, i_n) AS (VALUES {guard}),
{px}firsts AS (
  SELECT series, window_id, r, list_reduce(r, lambda acc, x: acc + x * x, CAST(0 AS DOUBLE)) / len(r) AS h1 FROM {px}samples),
{px}coarse AS (
  SELECT s.series, s.window_id, g.*, {_ll_of("s.r", "s.h1", "g.distribution", "g.alpha", "(g.persistence - g.alpha)", "coalesce(g.nu, 10.0)")} AS f
  FROM {px}firsts s CROSS JOIN {px}guard g),
{px}tops AS (
  SELECT series, window_id, distribution, alpha, persistence, nu, f.ll AS ll, f.h AS h_next FROM {px}coarse t WHERE NOT EXISTS (
    FROM {px}coarse u WHERE u.series = t.series AND u.window_id = t.window_id AND u.distribution = t.distribution
      AND abs(u.ia - t.ia) <= 1 AND abs(u.ip - t.ip) <= 1 AND abs(u.i_n - t.i_n) <= 1 AND u.f.ll > t.f.ll)),
{px}start AS (
  SELECT f.series, f.window_id, f.distribution, f.loglik AS grid_loglik, f.n_obs, s.r, s.h1, b.alpha, b.persistence, b.nu, b.ll, b.h_next
  FROM {px}fits f JOIN {px}firsts s USING (series, window_id) JOIN (
    SELECT series, window_id, distribution, alpha, persistence, nu, loglik AS ll, h_next FROM {px}fits
    UNION ALL SELECT * FROM {px}tops) b USING (series, window_id, distribution)),
{px}search AS (
  SELECT series, window_id, distribution, grid_loglik, n_obs, r, h1, alpha, persistence, nu, ll, h_next, CAST(0 AS INTEGER) AS halved, CAST(0 AS INTEGER) AS rounds FROM {px}start
  UNION ALL
  SELECT series, window_id, distribution, grid_loglik, n_obs, r, h1,
    CASE WHEN better THEN best.t.a ELSE alpha END, CASE WHEN better THEN best.t.p ELSE persistence END, CASE WHEN better THEN best.t.n ELSE nu END,
    CASE WHEN better THEN best.f.ll ELSE ll END, CASE WHEN better THEN best.f.h ELSE h_next END,
    CAST(CASE WHEN better THEN halved ELSE halved + 1 END AS INTEGER), rounds + 1
  FROM (SELECT *, round(best.f.ll, 7) > round(ll, 7) AS better FROM (
    SELECT *, list_reduce(list_transform(
        list_transform(CASE WHEN distribution = 'Normal' THEN {_offsets(False)} ELSE {_offsets(True)} END,
          lambda o: {{'a': least({clip_a}, {clip_p}), 'p': {clip_p}, 'n': {clip_n}}}),
        lambda t: {{'t': t, 'f': {ll}}}),
      lambda u, v: CASE WHEN (round(v.f.ll, 7), -v.t.a, -v.t.p, -coalesce(v.t.n, 0)) > (round(u.f.ll, 7), -u.t.a, -u.t.p, -coalesce(u.t.n, 0)) THEN v ELSE u END) AS best
    FROM {px}search WHERE halved < 12))),
{px}ended AS (
  SELECT *, row_number() OVER (PARTITION BY series, window_id, distribution ORDER BY ll DESC, alpha) AS best FROM {px}search WHERE halved = 12),
{px}polish AS (
  SELECT series, window_id, distribution, grid_loglik, n_obs, r, h1, alpha, persistence, coalesce(nu, 10.0) AS nu, 0 AS step
  FROM {px}ended WHERE best = 1
  UNION ALL
  {_newton_step(f"{px}polish")}),
{px}mle AS (
  SELECT series, window_id, distribution, grid_loglik, n_obs, r, h1, alpha, persistence, persistence - alpha AS beta, z.nu AS nu, f.ll AS loglik, f.h AS h_next
  FROM (SELECT *, {{'nu': CASE WHEN distribution = 'Normal' THEN NULL ELSE nu END}} AS z,
          {_ll_of("r", "h1", "distribution", "alpha", "(persistence - alpha)", "nu")} AS f
        FROM {px}polish WHERE step = {NEWTON_STEPS}))"""


#: Newton steps from the search's end; each squares what is left.
NEWTON_STEPS = 7


def _polygamma(x: str, order: int) -> str:
    """Digamma (0) or trigamma (1) of ``x``: shifted by 12, then the asymptotic series."""
    y = f"({x} + 12)"
    if order == 0:
        shift = " - ".join(f"1 / ({x} + {k})" for k in range(12))
        return (f"(ln({y}) - 0.5 / {y} - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) + 1 / (240 * pow({y}, 8)) "
                f"- 1 / (132 * pow({y}, 10)) - {shift})")
    shift = " + ".join(f"1 / pow({x} + {k}, 2)" for k in range(12))
    return (f"(1 / {y} + 0.5 / pow({y}, 2) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7)) - 1 / (30 * pow({y}, 9)) "
            f"+ 5 / (66 * pow({y}, 11)) + {shift})")


def _derivatives(alpha: str, beta: str, nu: str) -> str:
    """One scan over ``r``: gradient g*, Hessian h*, sums of score products s* in (a, b, n); Normal has none in n."""
    y, u, v, ab, bb = "(x * x / st.h)", "(st.a / st.h)", "(st.b / st.h)", "(st.ab / st.h)", "(st.bb / st.h)"
    k, half = f"({nu} - 2)", f"(({nu} + 1) / 2)"
    tot = f"({k} + {y})"
    student = {
        "d1": f"({half} * {y} / {tot} - 0.5)", "d2": f"(0.5 - {half} * {y} * (2 * {k} + {y}) / ({tot} * {tot}))",
        "n1": f"(c1 - 0.5 * ln(1 + {y} / {k}) + {half} * {y} / ({k} * {tot}))",
        "n2": f"(c2 + {y} / ({k} * {tot}) - {half} * {y} * (2 * {k} + {y}) / ({k} * {k} * {tot} * {tot}))",
        "hn": f"(0.5 * {y} / {tot} - {half} * {y} / ({tot} * {tot}))"}
    normal = {"d1": f"(0.5 * ({y} - 1))", "d2": f"(0.5 - {y})", "n1": "0.0", "n2": "0.0", "hn": "0.0"}

    def scan(t: dict[str, str]) -> str:
        score = {"a": f"{t['d1']} * {u}", "b": f"{t['d1']} * {v}", "n": t["n1"]}
        sums = {"ga": score["a"], "gb": score["b"], "gn": score["n"],
                "haa": f"{t['d2']} * {u} * {u}", "hab": f"{t['d2']} * {u} * {v} + {t['d1']} * {ab}", "hbb": f"{t['d2']} * {v} * {v} + {t['d1']} * {bb}",
                "han": f"{t['hn']} * {u}", "hbn": f"{t['hn']} * {v}", "hnn": t["n2"]}
        sums |= {f"s{i}{j}": f"({score[i]}) * ({score[j]})" for i, j in ("aa", "ab", "bb", "an", "bn", "nn")}
        path = {"h": f"{alpha} * x * x + {beta} * st.h", "a": f"x * x + {beta} * st.a", "b": f"st.h + {beta} * st.b",
                "ab": f"st.a + {beta} * st.ab", "bb": f"2 * st.b + {beta} * st.bb"}
        state = ", ".join([*(f"'{f}': {e}" for f, e in path.items()), *(f"'{f}': st.{f} + {e}" for f, e in sums.items())])
        zero = ", ".join(f"'{f}': CAST(0 AS DOUBLE)" for f in ("a", "b", "ab", "bb", *sums))
        return f"list_reduce(r, lambda st, x: {{{state}}}, {{'h': h1, {zero}}})"

    return f"CASE WHEN distribution = 'Normal' THEN {scan(normal)} ELSE {scan(student)} END"


def _nu_constants(nu: str) -> str:
    half, rest = f"(({nu} + 1) / 2)", f"({nu} / 2)"
    return (f"0.5 * {_polygamma(half, 0)} - 0.5 * {_polygamma(rest, 0)} - 0.5 / ({nu} - 2) AS c1, "
            f"0.25 * {_polygamma(half, 1)} - 0.25 * {_polygamma(rest, 1)} + 0.5 / pow({nu} - 2, 2) AS c2")


def _newton_step(src: str) -> str:
    """One Newton step in (alpha, persistence, nu); a coordinate that stands at a bound with the gradient pushing out is held."""
    keep = "series, window_id, distribution, grid_loglik, n_obs, r, h1"
    return f"""SELECT {keep},
    greatest(least(alpha - (i11 * g1 + i12 * g2 + i13 * g3) / det, least(greatest(persistence - (i12 * g1 + i22 * g2 + i23 * g3) / det, 0), 0.999)), 0),
    greatest(least(persistence - (i12 * g1 + i22 * g2 + i23 * g3) / det, 0.999), 0),
    greatest(least(nu - (i13 * g1 + i23 * g2 + i33 * g3) / det, 100.0), 2.1), step + 1
  FROM (SELECT *, m22 * m33 - m23 * m23 AS i11, m13 * m23 - m12 * m33 AS i12, m12 * m23 - m13 * m22 AS i13, m11 * m33 - m13 * m13 AS i22, m12 * m13 - m11 * m23 AS i23,
      m11 * m22 - m12 * m12 AS i33, m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13) AS det
  FROM (SELECT *, CASE WHEN ha THEN 0 ELSE z.ga - z.gb END AS g1, CASE WHEN hp THEN 0 ELSE z.gb END AS g2, CASE WHEN hn THEN 0 ELSE z.gn END AS g3,
      CASE WHEN ha THEN -1 ELSE z.haa - 2 * z.hab + z.hbb END AS m11, CASE WHEN ha OR hp THEN 0 ELSE z.hab - z.hbb END AS m12, CASE WHEN ha OR hn THEN 0 ELSE z.han - z.hbn END AS m13,
      CASE WHEN hp THEN -1 ELSE z.hbb END AS m22, CASE WHEN hp OR hn THEN 0 ELSE z.hbn END AS m23, CASE WHEN hn THEN -1 ELSE z.hnn END AS m33
  FROM (SELECT *, (alpha <= 0 AND z.ga < z.gb) OR (alpha >= persistence AND z.ga > z.gb) AS ha, persistence >= 0.999 AND z.gb > 0 AS hp,
      distribution = 'Normal' OR (nu >= 100 AND z.gn > 0) OR (nu <= 2.1 AND z.gn < 0) AS hn
  FROM (SELECT *, {_derivatives("alpha", "(persistence - alpha)", "nu")} AS z FROM (SELECT *, {_nu_constants("nu")} FROM {src} WHERE step < {NEWTON_STEPS})))))"""


def _offsets(student: bool) -> str:
    cells = [(a, p, n) for a in (-1, 0, 1) for p in (-1, 0, 1) for n in ((-1, 0, 1) if student else (0,))]
    return "[" + ", ".join(f"{{'a': {a}, 'p': {p}, 'n': {n}}}" for a, p, n in cells) + "]"


def _mle_base(base: tuple[str, ...], src: str, origin: str) -> str:
    return with_(*base, _in_sample(src, origin), _grid_cte(), LLS, _refined()).replace("WITH ", "WITH RECURSIVE ", 1)


MLE_COLS = ("series, '{s}' AS sampling, distribution, round(alpha, 6) AS alpha, round(persistence, 6) AS persistence, round(beta, 6) AS beta, "
            "round(nu, 6) AS nu, round(loglik, 6) AS loglik, round(grid_loglik, 6) AS grid_loglik, round(h_next, 6) AS h_next, n_obs, true AS converged")


def _both_samplings(select) -> str:
    """The 5-minute and the daily models, each a statement of its own."""
    five = _mle_base(INTRA, "ret5", TO) + select("5min")
    day = _mle_base(DAILY, "oret", DO) + select("daily")
    return f"SELECT * FROM ({five}) UNION ALL SELECT * FROM ({day})"


SQL["garch_mle_fit"] = _both_samplings(lambda s: f"SELECT {MLE_COLS.format(s=s)} FROM mle")


def _sandwich(student: bool) -> str:
    """CTE: robust standard errors of one distribution from exact derivatives, in closed form."""
    names = ("a", "b", "n")[: 3 if student else 2]
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    h = {(i, j): f"z.h{names[min(i, j)]}{names[max(i, j)]}" for i in range(k) for j in range(k)}
    if k == 2:
        det = f"({h[0, 0]} * {h[1, 1]} - {h[0, 1]} * {h[0, 1]})"
        inv = {(0, 0): f"({h[1, 1]} / det)", (0, 1): f"(-{h[0, 1]} / det)", (1, 1): f"({h[0, 0]} / det)"}
    else:
        def minor(i, j):
            r, c = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
            return f"({h[r[0], c[0]]} * {h[r[1], c[1]]} - {h[r[0], c[1]]} * {h[r[1], c[0]]})"
        det = f"({h[0, 0]} * {minor(0, 0)} - {h[0, 1]} * {minor(0, 1)} + {h[0, 2]} * {minor(0, 2)})"
        inv = {(i, j): f"({'-' if (i + j) % 2 else ''}{minor(i, j)} / det)" for i, j in pairs}
    g = lambda i, j: inv[min(i, j), max(i, j)]
    b = lambda i, j: f"z.s{names[min(i, j)]}{names[max(i, j)]}"
    var = [" + ".join(f"{g(m, i)} * {b(i, j)} * {g(j, m)}" for i in range(k) for j in range(k)) for m in range(k)]
    ses = [f"CASE WHEN ({v}) >= 0 THEN sqrt({v}) END AS se_{n}" for v, n in zip(var, ("alpha", "beta", "nu"), strict=False)] + ([] if student else ["NULL::DOUBLE AS se_nu"])
    dist, px = ("Student-t", "t") if student else ("Normal", "n")
    bounds = " OR NOT (nu > 2.1 AND nu < 100)" if student else ""
    return f"""{px}1 AS (SELECT *, {_nu_constants("coalesce(nu, 10.0)")} FROM mle WHERE distribution = '{dist}'),
{px}2 AS (SELECT *, {_derivatives("alpha", "beta", "coalesce(nu, 10.0)")} AS z FROM {px}1),
{px}3 AS (SELECT *, {det} AS det FROM {px}2),
{px}5 AS (SELECT series, distribution, alpha, beta, nu, alpha <= 0 OR beta <= 0 OR persistence >= 0.999{bounds} AS at_bound, {", ".join(ses)} FROM {px}3)"""


def _coef_select(sampling: str) -> str:
    rows = "[{'c': 'alpha', 'e': alpha, 's': se_alpha}, {'c': 'beta', 'e': beta, 's': se_beta}, {'c': 'nu', 'e': nu, 's': se_nu}]"
    return f""", {_sandwich(False)}, {_sandwich(True)},
coef AS (SELECT series, distribution, at_bound, unnest({rows}) AS u FROM (SELECT * FROM n5 UNION ALL BY NAME SELECT * FROM t5)),
coef2 AS (SELECT *, u.e / nullif(u.s, 0) AS t FROM coef WHERE u.e IS NOT NULL)
SELECT series, '{sampling}' AS sampling, distribution, u.c AS coefficient, round(u.e, 6) AS estimate, round({significant_sql('u.s', 8)}, 12) AS robust_se, round({significant_sql('t', 8)}, 6) AS t_value,
  round({normal_two_sided_sql('t')}, 6) AS p_value, true AS converged, at_bound FROM coef2"""


SQL["garch_coef_table"] = _both_samplings(_coef_select)


def _roll_mle(ctes: tuple[str, ...], px: str) -> tuple[str, ...]:
    """Rolling forecasts from refined fits instead of grid fits."""
    *first, fc = ctes
    return (*first, _refined(px), fc.replace(f"FROM {px}fits f", f"FROM {px}mle f"))


SQL["garch_roll_mle"] = _roll_sql(INTRA, "ret5", TO, "5min", refined=True)

MLE_FC = ((_grid_cte(),) + _roll_mle(_roll_ctes("ret5", TO, "5min", "a_"), "a_") + _roll_mle(_roll_ctes("dret", TO, "daily", "c_"), "c_") + ("""fc AS (
  SELECT series, distribution, forc_style, day, daily_variance_forecast FROM a_fc
  UNION ALL SELECT series, distribution, forc_style, day, daily_variance_forecast FROM c_fc)""",))
SQL["garch_result_table_mle"] = _result_sql("perf", _MAIN, base=(TICKS, BARS, RET5, DRET, RV, OUTLIER) + MLE_FC + (PERF,)).replace("WITH ", "WITH RECURSIVE ", 1)

SQL["garch_models"] = with_(*INTRA, _in_sample("ret5", TO), _grid_cte(), LLS) + """, specs(distribution, model,
  garch_p, garch_q, include_mean, omega, dist_code) AS (
  VALUES ('Normal', 'sGARCH', 1, 1, false, CAST(0 AS DOUBLE), 'norm'),
         ('Student-t', 'sGARCH', 1, 1, false, CAST(0 AS DOUBLE), 'std'))
SELECT f.series, f.distribution, s.model, CAST(s.garch_p AS INTEGER) AS garch_p, CAST(s.garch_q AS INTEGER) AS garch_q,
  s.include_mean, s.omega, s.dist_code, f.n_obs, round(f.alpha, 4) AS alpha, round(f.beta, 4) AS beta,
  round(f.nu, 4) AS nu, round(f.loglik, 4) AS loglik
FROM fits f JOIN specs s USING (distribution)"""

def _positive_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB's round keeps a negative
    zero, Spark's does not, and a value hash sees the sign bit."""
    out, i, n = [], 0, len(sql)
    while i < n:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            break
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < n:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _positive_zero(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + CAST(0 AS DOUBLE))")
        i = k + 1
    return "".join(out)


SQL = {name: _positive_zero(text) for name, text in SQL.items()}
