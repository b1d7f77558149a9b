"""DuckDB SQL of the queries in ``q_models``: plain recursions over whole series, and real range joins."""

from __future__ import annotations

from sigmaflow.plans import oracle_sql as O
from sigmaflow.plans.q_models import SLICE_AFTER, SLICE_LENGTH

SQL: dict[str, str] = {}

_ROW = "STRUCT(date TIMESTAMP, day TIMESTAMP, r DOUBLE, h DOUBLE)"


def _path(src: str, fits: str) -> str:
    """CTE ``path``: every bar's variance by one recursion a series and distribution from the in-sample mean square."""
    return f"""whole AS (SELECT series, list({{'date': date, 'day': day, 'r': "return"}} ORDER BY date) AS bars FROM {src} GROUP BY series),
models AS (
  SELECT f.series, f.distribution, f.alpha, f.beta, f.persistence, list_reduce(s.r, lambda acc, x: acc + x * x, CAST(0 AS DOUBLE)) / len(s.r) AS h1, w.bars
  FROM {fits} f JOIN samples s USING (series) JOIN whole w USING (series)),
path AS (
  SELECT series, distribution, alpha, beta, persistence, p.date AS date, p.day AS day, p.r AS r, p.h AS h FROM (
    SELECT *, unnest(list_reduce(bars, lambda st, x: {{'o': list_append(st.o, {{'date': x.date, 'day': x.day, 'r': x.r, 'h': st.h}}::{_ROW}), 'h': alpha * x.r * x.r + beta * st.h}},
      {{'o': []::{_ROW}[], 'h': h1}}).o) AS p FROM models))"""


def _path_select(origin: str) -> str:
    return f""" SELECT series, distribution, date, round(h, 6) AS h, round(sqrt(h), 6) AS sigma, round(r / nullif(sqrt(h), 0), 6) AS std_resid, day <= {origin} AS in_sample FROM path"""


_INTRA = O.with_(*O.INTRA, O._in_sample("ret5", O.TO), O._grid_cte(), O.LLS, _path("ret5", "fits"))
SQL["garch_variance_path"] = _INTRA + _path_select(O.TO)
SQL["garch_variance_path_mle"] = (O._mle_base(O.DAILY, "oret", O.DO) + ", " + _path("oret", "mle") + _path_select(O.DO))

_ENDS = f""", ends AS (
  SELECT series, distribution, arg_max(date, date) AS last_date, arg_max(r, date) AS r_last, arg_max(h, date) AS h_last, any_value(alpha) AS alpha, any_value(beta) AS beta
  FROM path WHERE day <= {O.TO} OR series = {{one}} GROUP BY 1, 2)"""
SQL["model_store_states"] = _INTRA + _ENDS.format(one="(SELECT min(series) FROM path)") + """ SELECT CAST(CASE WHEN e.series = (SELECT min(series) FROM path) THEN 2 ELSE 1 END AS INTEGER) AS part,
  e.series, e.distribution, round(e.alpha, 6) AS alpha, round(e.beta, 6) AS beta, round(f.nu, 6) AS nu, round(f.loglik, 4) AS loglik, f.n_obs, e.last_date,
  round(e.r_last, 6) AS r_last, round(e.h_last, 6) AS h_last, round(e.alpha * e.r_last * e.r_last + e.beta * e.h_last, 6) AS h_next
FROM ends e JOIN fits f USING (series, distribution)"""
SQL["model_store_resumed_forecast"] = _INTRA + f""", starts AS (
  SELECT series, distribution, day, count(*) AS n_ahead, arg_min(h, date) AS h_next, any_value(persistence) AS persistence FROM path WHERE day > {O.TO} GROUP BY 1, 2, 3)
SELECT series, distribution, day, n_ahead, round(h_next, 6) AS h_start, round({O.DAILY_VAR}, 6) AS daily_variance_forecast FROM starts"""

_SLICES = f"""slices AS (
  SELECT series, CAST(date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS BIGINT) AS slice_id, min(date) + INTERVAL {SLICE_AFTER} SECOND AS lo,
         min(date) + INTERVAL {SLICE_AFTER + SLICE_LENGTH} SECOND AS hi FROM ret5 GROUP BY 1, 2)"""
SQL["time_slice_sums"] = O.with_(*O.INTRA, _SLICES) + """ SELECT s.series, s.slice_id, s.lo, s.hi, count(r.date) AS n_rows, count(r.date) - count(r."return") AS n_null,
  round(sum(r."return"), 6) AS total, round(sum(r."return" * r."return"), 6) AS total_sq, min(r.date) AS first_date, max(r.date) AS last_date
FROM slices s LEFT JOIN ret5 r ON r.series = s.series AND r.date BETWEEN s.lo AND s.hi GROUP BY ALL"""
SQL["time_slice_rows"] = O.with_(*O.INTRA, _SLICES) + """ SELECT s.series, s.slice_id, r.date, round(r."return", 6) AS "return"
FROM slices s JOIN ret5 r ON r.series = s.series AND r.date BETWEEN s.lo AND s.hi"""

SQL = {name: O._positive_zero(text) for name, text in SQL.items()}
