"""DuckDB SQL of the queries in ``q_tables``."""

from __future__ import annotations

from sigmaflow.plans import oracle_sql as O
from sigmaflow.plans.q_tables import ZONE_PARAMS

SQL: dict[str, str] = {}

_LINES = """lines AS (SELECT *, tick_id % 97 AS k FROM ticks)"""
SQL["scan_inferred_prices"] = O.with_(O.TICKS, _LINES) + """ SELECT series, date_trunc('second', date) AS date, round(adjusted, 6) AS adjusted
FROM lines WHERE k NOT BETWEEN 1 AND 6 AND adjusted IS NOT NULL"""
SQL["scan_quarantine"] = O.with_(O.TICKS, _LINES) + """, found AS (
  SELECT unnest(CASE WHEN k IN (3, 4) THEN ['number of fields'] ELSE list_filter([
    CASE WHEN k IN (2, 6) THEN 'Timestamp: not a bigint' END, CASE WHEN k IN (1, 6) THEN 'Weighted_Price: not a double' END,
    CASE WHEN k = 5 OR (adjusted IS NULL AND k NOT IN (1, 6)) THEN 'Weighted_Price: missing' END], lambda r: r IS NOT NULL) END) AS reason FROM lines)
SELECT reason, count(*) AS n_lines FROM found GROUP BY 1"""

_ZONE = ZONE_PARAMS.tz
_LOCAL = f"((date AT TIME ZONE 'UTC') AT TIME ZONE '{_ZONE}')"
_TICKS = """zt AS (
  SELECT o_orderpriority AS series, o_orderdate + INTERVAL (o_orderkey * 7919 % 86400) SECOND AS date, o_totalprice AS adjusted, o_orderkey AS tick_id
  FROM orders WHERE o_totalprice IS NULL OR o_totalprice > 0)"""
_RETURNS = f"""zb AS (
  SELECT series, date_trunc('hour', date) AS bar, min(date) AS date, arg_min(adjusted, (date, tick_id)) AS adjusted FROM zt GROUP BY 1, 2),
zr AS (
  SELECT series, date, CAST(CAST({_LOCAL} AS DATE) AS TIMESTAMP) AS day, "return" FROM (
    SELECT series, date, ln(adjusted) - ln(lag(adjusted) OVER w) AS "return", row_number() OVER w AS rn FROM zb WINDOW w AS (PARTITION BY series ORDER BY date)) WHERE rn > 1)"""
SQL["zone_realized_variance"] = O.with_(_TICKS, _RETURNS) + f""" SELECT series, day, max(date) AS date, round(sum("return" * "return"), 6) AS realized_variance,
  round(epoch(((day + INTERVAL 1 DAY) AT TIME ZONE '{_ZONE}') - (day AT TIME ZONE '{_ZONE}')) / 3600, 6) AS hours FROM zr GROUP BY series, day"""
SQL["zone_daily_close"] = O.with_(_TICKS) + f""" SELECT series, CAST(CAST({_LOCAL} AS DATE) AS TIMESTAMP) AS day, max(date) AS date,
  round(arg_max(adjusted, (date, tick_id)), 6) AS adjusted FROM zt GROUP BY 1, 2"""
SQL["zone_forecast_horizon"] = O.with_(_TICKS, _RETURNS, O._days("zr", O._day(ZONE_PARAMS.origin_day))) + """ SELECT series, CAST(window_id AS BIGINT) AS window_id,
  target_day, lo, hi, n_fit, CAST(n_ahead AS BIGINT) AS n_ahead FROM windows"""

SQL["nested_mz"] = O.with_(*O.EVAL_BASE, O._ols_cte("perf3", "realized_variance", "daily_variance_forecast", O.GRP)) + f""" SELECT {O.GRP}, CAST(n AS BIGINT) AS nobs,
  round(intercept, 6) AS intercept, round(slope, 6) AS slope, round(r_squared, 6) AS r_squared, round(sse, 6) AS sse FROM ols4"""
SQL["nested_roundtrip"] = O.with_(*O.INTRA) + """ SELECT series, date, round(adjusted, 6) AS adjusted, round("return", 6) AS "return" FROM ret5"""
SQL["sorted_files_order"] = O.with_(*O.INTRA) + """ SELECT series, date, round("return", 6) AS "return", row_number() OVER (ORDER BY date, series) AS position FROM ret5"""

SQL = {name: O._positive_zero(text) for name, text in SQL.items()}
