"""Window and aggregate metric queries over the fact panel and the event panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import panel as P
from . import facts as FX
from . import sqlparts as S
from .edge import sql_finish
from .registry import CUST, SEG, register
from .registry import with_ctes as _with

_SEGP = S.panel_cte(SEG)
_CUSTP = S.panel_cte(CUST)
_QIDX = "(year(period) * 4 + quarter(period))"


def _trailing_sql(key: str, cte: str) -> str:
    return _with(cte) + f"""
SELECT {key}, period, write_offs,
  CASE WHEN count(write_offs) OVER w = 4 THEN sum(write_offs) OVER w END AS write_offs_4q,
  CASE WHEN count(write_offs) OVER wr = 4 THEN sum(write_offs) OVER wr END AS write_offs_4q_contiguous
FROM panel
WINDOW w AS (PARTITION BY {key} ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
       wr AS (PARTITION BY {key} ORDER BY {_QIDX} RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)"""


@register("trailing4_full", sql=sql_finish(_trailing_sql("c_mktsegment", _SEGP), keep=["c_mktsegment", "period"]))
def trailing4_full(spark, sf_dir):
    p = FX.fact_panel(spark, sf_dir, SEG, line_level=False)
    return M.trailing_sum(p, SEG, "write_offs").select(*SEG, "period", "write_offs", "write_offs_4q",
                                                       "write_offs_4q_contiguous")


@register("trailing4_range", sql=sql_finish(_trailing_sql("o_custkey", _CUSTP), keep=["o_custkey", "period"]))
def trailing4_range(spark, sf_dir):
    """Sparse customer panel: gaps make ROWS and RANGE windows differ."""
    p = FX.fact_panel(spark, sf_dir, CUST, line_level=False)
    return M.trailing_sum(p, CUST, "write_offs").select(*CUST, "period", "write_offs", "write_offs_4q",
                                                        "write_offs_4q_contiguous")


_EVP = """panel AS (
  SELECT event_type, CAST(ts AS DATE) AS period, count(*) AS events,
    sum(CAST(value AS DECIMAL(18,2))) AS value, count(DISTINCT user_id) AS users
  FROM events GROUP BY ALL)"""


@register("trailing7_events", sql=sql_finish(_with(_EVP) + """
SELECT event_type, period, events, value, users,
  CASE WHEN count(value) OVER w = 7 THEN sum(value) OVER w END AS value_7d,
  CASE WHEN count(value) OVER wr = 7 THEN sum(value) OVER wr END AS value_7d_contiguous
FROM panel
WINDOW w AS (PARTITION BY event_type ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       wr AS (PARTITION BY event_type ORDER BY CAST(period - DATE '1970-01-01' AS BIGINT)
              RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)""", keep=["event_type", "period", "events", "users"]))
def trailing7_events(spark, sf_dir):
    p = FX.events_panel(spark, sf_dir)
    day = F.datediff("period", F.lit("1970-01-01").cast("date"))
    return M.trailing_sum(p, ["event_type"], "value", n=7, name="value_7d", index=day)


@register("yoy_rate_change", sql=sql_finish(_with(_SEGP) + f"""
SELECT c_mktsegment, period, rate_pct,
  rate_pct - lag(rate_pct, 4) OVER w AS rate_pct_yoy,
  CASE WHEN {_QIDX} - lag({_QIDX}, 4) OVER w = 4 THEN rate_pct - lag(rate_pct, 4) OVER w END AS rate_pct_yoy_checked
FROM panel WINDOW w AS (PARTITION BY c_mktsegment ORDER BY period)""", keep=["c_mktsegment", "period"]))
def yoy_rate_change(spark, sf_dir):
    p = FX.fact_panel(spark, sf_dir, SEG, line_level=False)
    return M.yoy_change(p, SEG, "rate_pct").select(*SEG, "period", "rate_pct", "rate_pct_yoy",
                                                   "rate_pct_yoy_checked")


@register("seq_number", sql=sql_finish(_with(_SEGP) + """
SELECT c_mktsegment, period, seq,
  (min(seq) OVER k = 1 AND max(seq) OVER k = count(*) OVER k) AS seq_is_permutation
FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY period) AS seq FROM panel) AS s
WINDOW k AS (PARTITION BY c_mktsegment)""", keep=["c_mktsegment", "period", "seq", "seq_is_permutation"]))
def seq_number(spark, sf_dir):
    p = M.sequence_number(FX.fact_panel(spark, sf_dir, SEG, line_level=False), SEG)
    k = Window.partitionBy(*SEG)
    ok = (F.min("seq").over(k) == 1) & (F.max("seq").over(k) == F.count(F.lit(1)).over(k))
    return p.select(*SEG, "period", "seq", ok.alias("seq_is_permutation"))


@register("trailing4_by_seq", sql=sql_finish(_with(_SEGP) + """
SELECT a.c_mktsegment, a.period, a.seq, CASE WHEN c.n = 4 THEN c.s END AS write_offs_4q_by_seq,
  (CASE WHEN c.n = 4 THEN c.s END IS NOT DISTINCT FROM a.t) AS matches_window
FROM (SELECT *, row_number() OVER w AS seq,
        CASE WHEN count(write_offs) OVER w4 = 4 THEN sum(write_offs) OVER w4 END AS t
      FROM panel WINDOW w AS (PARTITION BY c_mktsegment ORDER BY period),
                        w4 AS (PARTITION BY c_mktsegment ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS a
LEFT JOIN (
  SELECT c_mktsegment, tseq AS seq, sum(write_offs) AS s, count(write_offs) AS n
  FROM (SELECT c_mktsegment, write_offs, unnest(generate_series(seq, seq + 3)) AS tseq
        FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY period) AS seq FROM panel) AS q) AS e
  GROUP BY ALL) AS c ON c.c_mktsegment = a.c_mktsegment AND c.seq = a.seq""",
    keep=["c_mktsegment", "period", "seq", "matches_window"]))
def trailing4_by_seq(spark, sf_dir):
    p = FX.fact_panel(spark, sf_dir, SEG, line_level=False, materialize=True)
    t = M.trailing_sum(p, SEG, "write_offs", name="t")
    s = M.trailing_by_sequence(t, SEG, "write_offs")
    return s.select(*SEG, "period", "seq", "write_offs_4q_by_seq",
                    F.col("write_offs_4q_by_seq").eqNullSafe(F.col("t")).alias("matches_window"))


@register("first_full_window", sql=sql_finish(_with(_CUSTP) + """
SELECT o_custkey, min(CASE WHEN t IS NOT NULL THEN seq END) AS first_full_seq,
  min(CASE WHEN t IS NOT NULL THEN period END) AS first_full_period, count(*) AS periods
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY period) AS seq,
        CASE WHEN count(write_offs) OVER w4 = 4 THEN sum(write_offs) OVER w4 END AS t
      FROM panel WINDOW w4 AS (PARTITION BY o_custkey ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS x
GROUP BY o_custkey""", keep=["o_custkey", "first_full_seq", "first_full_period", "periods"]))
def first_full_window(spark, sf_dir):
    return M.first_full_window(FX.fact_panel(spark, sf_dir, CUST, line_level=False), CUST, "write_offs")


@register("recent_periods", sql=sql_finish(_with(_SEGP) + f"""
SELECT c_mktsegment, period, {_QIDX} AS period_index,
  CAST(year(period) AS VARCHAR) || ' Q' || CAST(quarter(period) AS VARCHAR) AS period_label,
  write_offs, rate_pct
FROM (SELECT *, max({_QIDX}) OVER (PARTITION BY c_mktsegment) AS latest FROM panel) AS x
WHERE {_QIDX} >= latest - 3""", keep=["c_mktsegment", "period", "period_index", "period_label"]))
def recent_periods(spark, sf_dir):
    p = FX.fact_panel(spark, sf_dir, SEG, line_level=False)
    return M.recent_periods(p, SEG).select(*SEG, "period", "period_index", "period_label", "write_offs", "rate_pct")


@register("window_stats", sql=sql_finish(_with(_SEGP, """years AS (
  SELECT DISTINCT c_mktsegment, CAST(year(period) AS BIGINT) AS year FROM panel)""", """windows AS (
  SELECT c_mktsegment, year AS window_id,
    CAST(unnest(generate_series(make_date(year, 1, 1), make_date(year, 10, 1), INTERVAL 3 MONTH)) AS DATE) AS period,
    CAST(4 AS BIGINT) AS expected
  FROM years)""") + """
SELECT *, loss / avg_balance AS ratio, loss / avg_balance * 100 * 4 / expected AS rate_pct,
  nq = expected AS complete FROM (
  SELECT x.c_mktsegment, window_id, CASE WHEN count(write_offs) = max(expected) THEN CAST(sum(write_offs) AS DOUBLE) END AS loss,
    CASE WHEN count(rollover) = max(expected) THEN CAST(sum(rollover) AS DOUBLE) / max(expected) END AS avg_balance,
    CASE WHEN count(rate_pct) = max(expected) THEN CAST(sum(rate_pct) AS DOUBLE) / max(expected) END AS rate_pub,
    count(p.period) AS nq, max(expected) AS expected, min(p.period) AS first_period, max(p.period) AS last_period
  FROM windows x LEFT JOIN panel p ON p.c_mktsegment = x.c_mktsegment AND p.period = x.period
  GROUP BY ALL) AS s""", keep=["c_mktsegment", "window_id", "nq", "expected", "first_period", "last_period",
                                "complete"]))
def window_stats(spark, sf_dir):
    p = FX.fact_panel(spark, sf_dir, SEG, line_level=False, materialize=True)
    years = P.with_year(p).select(*SEG, "year").distinct()
    return P.window_stats(p, P.year_windows(years, SEG), SEG)


@register("seasonal_means", sql=sql_finish(_with(_SEGP, S.annual_cte(SEG)) + """
SELECT p.c_mktsegment, CAST(quarter(period) AS BIGINT) AS quarter_of_year,
  CAST(sum(rate_pct) AS DOUBLE) / count(rate_pct) AS mean_rate_pct, count(rate_pct) AS years
FROM panel p SEMI JOIN annual a ON a.c_mktsegment = p.c_mktsegment AND a.year = year(p.period)
GROUP BY ALL""", keep=["c_mktsegment", "quarter_of_year", "years"]))
def seasonal_means(spark, sf_dir):
    return M.seasonal_means(FX.fact_panel(spark, sf_dir, SEG, line_level=False, materialize=True), SEG, "rate_pct")


_MEASURES = ["principal", "supplementary", "billings", "rollover", "write_offs", "rate_pct"]


_LONG_SQL = " UNION ALL ".join(
    f"SELECT c_mktsegment, period, '{m}' AS series, CAST({m} AS DOUBLE) AS value FROM panel"
    for m in ["principal", "supplementary", "billings", "rollover", "write_offs", "rate_pct"])


@register("series_profile", sql=sql_finish(_with(_SEGP) + f"""
SELECT c_mktsegment, series, min(value) AS min_value, max(value) AS max_value,
  count(*) FILTER (WHERE value IS NULL) AS nulls, count(*) AS periods,
  min(period) AS first_period, max(period) AS last_period
FROM ({_LONG_SQL}) AS u
GROUP BY ALL""", keep=["c_mktsegment", "series", "nulls", "periods", "first_period", "last_period"]))
def series_profile(spark, sf_dir):
    return M.series_profile(FX.fact_panel(spark, sf_dir, SEG), SEG, _MEASURES)


@register("largest_move", sql=sql_finish(_with(_SEGP) + """
SELECT c_mktsegment, m.p0 AS from_period, m.p AS to_period, m.v0 AS from_value, m.v AS to_value,
  m.v - m.v0 AS change, (m.v / m.v0 - 1) * 100 AS change_pct
FROM (SELECT c_mktsegment, arg_max({'p0': p0, 'p': period, 'v0': v0, 'v': v}, {'d': abs(v - v0), 'p0': p0}) AS m
      FROM (SELECT c_mktsegment, period, CAST(principal AS DOUBLE) AS v,
              lag(period) OVER w AS p0, lag(CAST(principal AS DOUBLE)) OVER w AS v0
            FROM panel WINDOW w AS (PARTITION BY c_mktsegment ORDER BY period)) AS x
      WHERE p0 IS NOT NULL AND v IS NOT NULL AND v0 IS NOT NULL GROUP BY c_mktsegment) AS y""",
    keep=["c_mktsegment", "from_period", "to_period"]))
def largest_move(spark, sf_dir):
    return M.largest_move(FX.fact_panel(spark, sf_dir, SEG, line_level=False), SEG, "principal")


@register("decline_count", sql=sql_finish(_with(_SEGP) + """
SELECT c_mktsegment,
  count(*) FILTER (WHERE year = py + 1 AND avg_value < prev) AS declining_years,
  count(*) FILTER (WHERE year = py + 1) AS year_pairs,
  min(year) AS first_year, max(year) AS last_year,
  arg_min(avg_value, year) AS first_value, arg_max(avg_value, year) AS last_value,
  (arg_max(avg_value, year) / arg_min(avg_value, year) - 1) * 100 AS endpoint_change_pct
FROM (SELECT *, lag(avg_value) OVER w AS prev, lag(year) OVER w AS py
      FROM (SELECT c_mktsegment, CAST(year(period) AS BIGINT) AS year,
              CAST(sum(supplementary) AS DOUBLE) / count(*) AS avg_value
            FROM panel GROUP BY ALL HAVING count(*) = 4) AS a
      WINDOW w AS (PARTITION BY c_mktsegment ORDER BY year)) AS b
GROUP BY c_mktsegment""", keep=["c_mktsegment", "declining_years", "year_pairs", "first_year", "last_year"]))
def decline_count(spark, sf_dir):
    return M.decline_count(FX.fact_panel(spark, sf_dir, SEG), SEG, "supplementary")


@register("peak_period", sql=sql_finish(_with(_SEGP, S.annual_cte(SEG), S.published_cte(SEG)) + """
SELECT a.c_mktsegment, coalesce(a.peak_pub, a.peak_proxy) AS peak_year,
  CASE WHEN a.published_years > 0 THEN 'published' ELSE 'proxy' END AS peak_basis,
  t.max_loss_period, t.max_loss
FROM (SELECT x.c_mktsegment,
        arg_max(x.year, CASE WHEN p.pub_rate_pct IS NOT NULL THEN {'r': p.pub_rate_pct, 'y': -x.year} END) AS peak_pub,
        arg_max(x.year, {'r': x.rate_pct_recomputed, 'y': -x.year}) AS peak_proxy,
        count(p.pub_rate_pct) AS published_years
      FROM annual x LEFT JOIN published p ON p.c_mktsegment = x.c_mktsegment AND p.year = x.year
      GROUP BY x.c_mktsegment) AS a
LEFT JOIN (SELECT c_mktsegment,
             arg_max(period, {'w': write_offs, 'd': -(period - DATE '1970-01-01')}) AS max_loss_period,
             max(CAST(write_offs AS DOUBLE)) AS max_loss
           FROM panel WHERE write_offs IS NOT NULL GROUP BY c_mktsegment) AS t
  ON t.c_mktsegment = a.c_mktsegment""", keep=["c_mktsegment", "peak_year", "peak_basis", "max_loss_period"]))
def peak_period(spark, sf_dir):
    p = FX.fact_panel(spark, sf_dir, SEG, line_level=False, materialize=True)
    return M.peak_period(p, SEG, FX.published_annual(p, SEG))


@register("rate_path", sql=sql_finish(_with(_SEGP, S.annual_cte(SEG)) + """
SELECT c_mktsegment, year, r2 AS rate_two_before, r1 AS rate_before, r AS rate_latest,
  r1 - r2 AS step_before, r - r1 AS step_latest
FROM (SELECT c_mktsegment, year, rate_pct_recomputed AS r,
        lag(rate_pct_recomputed, 1) OVER w AS r1, lag(rate_pct_recomputed, 2) OVER w AS r2,
        lag(year, 1) OVER w AS y1, lag(year, 2) OVER w AS y2,
        max(year) OVER (PARTITION BY c_mktsegment) AS last
      FROM annual WINDOW w AS (PARTITION BY c_mktsegment ORDER BY year)) AS x
WHERE year = last AND y1 = year - 1 AND y2 = year - 2""", keep=["c_mktsegment", "year"]))
def rate_path(spark, sf_dir):
    return M.rate_path(FX.fact_panel(spark, sf_dir, SEG, line_level=False), SEG)


@register("per_unit", sql=sql_finish(_with(_SEGP) + """
SELECT c_mktsegment, year, lpp AS loss_per_principal,
  CASE WHEN py = year - 1 THEN (lpp / prev - 1) * 100 END AS loss_per_principal_change_pct,
  r * 1.0 / (p + s) AS balance_per_unit, r / b AS balance_to_billings
FROM (SELECT *, lag(lpp) OVER w AS prev, lag(year) OVER w AS py
      FROM (SELECT *, w * 1.0 / p AS lpp
            FROM (SELECT c_mktsegment, CAST(year(period) AS BIGINT) AS year,
                    CASE WHEN count(write_offs) = 4 THEN CAST(sum(write_offs) AS DOUBLE) END AS w,
                    CASE WHEN count(principal) = 4 THEN CAST(sum(principal) AS DOUBLE) / 4 END AS p,
                    CASE WHEN count(supplementary) = 4 THEN CAST(sum(supplementary) AS DOUBLE) / 4 END AS s,
                    CASE WHEN count(rollover) = 4 THEN CAST(sum(rollover) AS DOUBLE) / 4 END AS r,
                    CASE WHEN count(billings) = 4 THEN CAST(sum(billings) AS DOUBLE) / 4 END AS b
                  FROM panel GROUP BY ALL HAVING count(*) = 4) AS a) AS b
      WINDOW w AS (PARTITION BY c_mktsegment ORDER BY year)) AS c""", keep=["c_mktsegment", "year"]))
def per_unit(spark, sf_dir):
    return M.per_unit(FX.fact_panel(spark, sf_dir, SEG), SEG, unit_scale=1.0)
