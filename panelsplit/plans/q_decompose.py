"""Decomposition queries: base-weighted and endpoint splits, shape, book
split, published-rate basis, sensitivity table and chart data."""

from __future__ import annotations

from ..operators import chartdata as C
from ..operators import decompose as D
from ..operators.sensitivity import VARIANTS, sensitivity
from . import facts as FX
from . import sqlparts as S
from .edge import sql_finish
from .registry import CUST, SEG, register
from .registry import with_ctes as _with

_K = "c_mktsegment"
_BASE = [S.panel_cte(SEG), S.annual_cte(SEG),
         "aw AS (SELECT c_mktsegment, year, write_offs AS W, avg_rollover AS R FROM annual)",
         S.pairs_cte(SEG, "aw", ["W", "R"])]
_B = S.inline_bridge("W0", "R0", "W", "R")


@register("bridge_base_weighted", sql=sql_finish(_with(*_BASE) + f"""
SELECT c_mktsegment, year, year0 AS previous_year, {_B['d_w']} AS delta_write_offs,
  {_B['volume_b']} AS volume, {_B['rate_b']} AS rate, {_B['inter_b']} AS joint,
  {_B['d_w']} - {_B['volume_b']} - {_B['rate_b']} - {_B['inter_b']} AS residual,
  abs({_B['volume_b']} + {_B['rate_b']} + {_B['inter_b']} - {_B['d_w']}) <= 1e-9 * greatest(1.0, abs({_B['d_w']}))
    AS closes
FROM pairs""", keep=[_K, "year", "previous_year", "closes"]))
def bridge_base_weighted(spark, sf_dir):
    return D.base_weighted_bridge(FX.fact_panel(spark, sf_dir, SEG, line_level=False), SEG)


_E = S.inline_bridge("W0", "R0", "W1", "R1")


@register("bridge_endpoint", sql=sql_finish(_with(S.panel_cte(SEG), S.annual_cte(SEG)) + f"""
SELECT c_mktsegment, CAST(1996 AS BIGINT) AS year_old, CAST(2000 AS BIGINT) AS year_new,
  W0 AS write_offs_old, W1 AS write_offs_new, {_E['d_w']} AS delta_write_offs,
  {_E['volume']} AS volume, {_E['rate']} AS rate, {_E['inter']} AS interaction, {_E['closes']} AS closes
FROM (SELECT c_mktsegment,
        max(CASE WHEN year = 1996 THEN write_offs END) AS W0, max(CASE WHEN year = 1996 THEN avg_rollover END) AS R0,
        max(CASE WHEN year = 2000 THEN write_offs END) AS W1, max(CASE WHEN year = 2000 THEN avg_rollover END) AS R1,
        count(*) AS n
      FROM annual WHERE year IN (1996, 2000) GROUP BY c_mktsegment) AS x
WHERE n = 2""", keep=[_K, "year_old", "year_new", "closes"]))
def bridge_endpoint(spark, sf_dir):
    """1996 -> 2000 in one step; not the sum of the four yearly splits."""
    return D.bridge_between(FX.fact_panel(spark, sf_dir, SEG, line_level=False), SEG, 1996, 2000)


@register("bridge_shape", sql=sql_finish(_with(*_BASE) + f"""
SELECT c_mktsegment, year, {_B['volume']} AS volume, {_B['rate']} AS rate,
  CASE WHEN abs({_B['rate']}) > abs({_B['volume']}) THEN 'rate-led' ELSE 'volume-led' END AS shape
FROM pairs""", keep=[_K, "year", "shape"]))
def bridge_shape(spark, sf_dir):
    b = D.yearly_bridge(FX.fact_panel(spark, sf_dir, SEG, line_level=False), SEG)
    return b.select(*SEG, "year", "volume", "rate", D.shape_label("volume", "rate").alias("shape"))


def _book_sql(key: str = _K) -> str:
    book = f"""book AS (
  SELECT {key}, CAST(year(period) AS BIGINT) AS year,
    CASE WHEN count(principal) = 4 THEN CAST(sum(principal) AS DOUBLE) / 4 END AS p,
    CASE WHEN count(supplementary) = 4 THEN CAST(sum(supplementary) AS DOUBLE) / 4 END AS s,
    CASE WHEN count(rollover) = 4 THEN CAST(sum(rollover) AS DOUBLE) / 4 END AS r,
    CASE WHEN count(billings) = 4 THEN CAST(sum(billings) AS DOUBLE) / 4 END AS b,
    CASE WHEN count(write_offs) = 4 THEN CAST(sum(write_offs) AS DOUBLE) END AS w,
    CAST(max(CASE WHEN month(period) = 10 THEN principal END) AS DOUBLE) AS pe,
    CAST(max(CASE WHEN month(period) = 10 THEN supplementary END) AS DOUBLE) AS se,
    CAST(max(CASE WHEN month(period) = 10 THEN rollover END) AS DOUBLE) AS re
  FROM panel GROUP BY ALL HAVING count(*) = 4)"""
    pairs = S.pairs_cte([key], "book", ["p", "s", "r", "b", "w", "pe", "se", "re"], name="bp")
    ext = "bx AS (SELECT *, p + s AS c1, p0 + s0 AS c0, pe + se AS ce1, pe0 + se0 AS ce0 FROM bp)"
    t = S.inline_bridge("r0", "c0", "r", "c1")
    pp = S.inline_bridge("r0", "p0", "r", "p")
    et = S.inline_bridge("re0", "ce0", "re", "ce1")
    ep = S.inline_bridge("re0", "pe0", "re", "pe")
    return _with(S.panel_cte([key]), book, pairs, ext) + f"""
SELECT {key}, year, year0 AS previous_year, p AS avg_principal, s AS avg_supplementary, c1 AS avg_total,
  r * 1.0 / c1 AS rollover_per_unit, w * 1.0 / p AS write_offs_per_principal, r / b AS rollover_to_billings,
  r - r0 AS delta_rollover, {t['volume']} AS count_effect, {t['rate']} AS per_unit_effect,
  r * 1.0 / p AS rollover_per_principal, {pp['volume']} AS principal_count_effect,
  {pp['rate']} AS per_principal_effect, (c1 / c0 - 1) * 100 AS avg_total_change_pct,
  (p / p0 - 1) * 100 AS avg_principal_change_pct, pe AS year_end_principal, se AS year_end_supplementary,
  ce1 AS year_end_total, re AS year_end_rollover, re * 1.0 / ce1 AS year_end_rollover_per_unit,
  re * 1.0 / pe AS year_end_rollover_per_principal, re - re0 AS year_end_delta_rollover,
  {et['volume']} AS year_end_count_effect, {et['rate']} AS year_end_per_unit_effect,
  {ep['volume']} AS year_end_principal_count_effect, {ep['rate']} AS year_end_per_principal_effect,
  (ce1 / ce0 - 1) * 100 AS year_end_total_change_pct, (pe / pe0 - 1) * 100 AS year_end_principal_change_pct,
  ({t['closes']} AND {pp['closes']} AND {et['closes']} AND {ep['closes']}) AS closes
FROM bx"""


@register("book_split", sql=sql_finish(_book_sql(), keep=[_K, "year", "previous_year", "closes"]))
def book_split(spark, sf_dir):
    return D.book_split(FX.fact_panel(spark, sf_dir, SEG), SEG, unit_scale=1.0)


@register("book_split_customer", sql=sql_finish(_book_sql("o_custkey"), keep=["o_custkey", "year", "previous_year", "closes"]))
def book_split_customer(spark, sf_dir):
    """The book split of every customer: years that lack a quarter or a value have none."""
    return D.book_split(FX.fact_panel(spark, sf_dir, CUST), CUST, unit_scale=1.0)


@register("published_basis", sql=sql_finish(_with(
    S.panel_cte(SEG), S.annual_cte(SEG), S.published_cte(SEG),
    """aw AS (SELECT a.c_mktsegment, a.year, write_offs AS W, avg_rollover AS R, pub_rate_pct AS P
  FROM annual a LEFT JOIN published p ON p.c_mktsegment = a.c_mktsegment AND p.year = a.year)""",
    S.pairs_cte(SEG, "aw", ["W", "R", "P"])) + f"""
SELECT c_mktsegment, year, year0 AS previous_year, P0 AS rate_pub_old, P AS rate_pub_new,
  {_B['d_w']} AS delta_write_offs, vol_p AS volume, rate_p AS rate,
  {_B['d_w']} - vol_p - rate_p AS residual,
  vol_p - {_B['volume']} AS volume_vs_recomputed, rate_p - {_B['rate']} AS rate_vs_recomputed
FROM (SELECT *, {_B['d_base']} * (P0 / 100 + P / 100) / 2 AS vol_p,
        (P / 100 - P0 / 100) * (R0 + R) / 2 AS rate_p
      FROM pairs WHERE P0 IS NOT NULL AND P IS NOT NULL) AS x""", keep=[_K, "year", "previous_year"]))
def published_basis(spark, sf_dir):
    panel = FX.fact_panel(spark, sf_dir, SEG, line_level=False, materialize=True)
    return D.bridge_with_rates(panel, FX.published_annual(panel, SEG), SEG)


def _sensitivity_sql(key: str = _K) -> str:
    side_cols = ["w", "bal", "rate_pct", "wy", "p_first", "p_last"]
    wide_aggs = ", ".join(f"max(CASE WHEN side = '{s}' THEN {c} END) AS {c}_{s}"
                          for s in ("old", "new") for c in side_cols)
    variants = ", ".join(f"'{v}'" for v in VARIANTS)
    b = S.bridge_select("w_old", "bal_old", "w_new", "bal_new", "wide2")
    span = "strftime({0}, '%Y-%m') || ' → ' || strftime({1}, '%Y-%m')"
    return _with(
        S.panel_cte([key]), S.annual_cte([key]), S.published_cte([key]),
        f"""a2 AS (SELECT x.{key}, x.year, x.rate_pct_recomputed, p.pub_rate_pct,
    lag(x.year) OVER wo = x.year - 1 AS prev_complete, lag(p.pub_rate_pct) OVER wo AS prev_pub
  FROM annual x LEFT JOIN published p ON p.{key} = x.{key} AND p.year = x.year
  WINDOW wo AS (PARTITION BY x.{key} ORDER BY x.year))""",
        f"""a3 AS (SELECT *, max(year) OVER w AS latest,
    arg_max(year, CASE WHEN pub_rate_pct IS NOT NULL THEN {{'r': pub_rate_pct, 'y': -year}} END) OVER w AS peak_pub,
    arg_max(year, {{'r': rate_pct_recomputed, 'y': -year}}) OVER w AS peak_proxy,
    max(CASE WHEN prev_complete AND pub_rate_pct IS NOT NULL AND prev_pub IS NOT NULL THEN year END) OVER w
      AS pub_year
  FROM a2 WINDOW w AS (PARTITION BY {key}))""",
        f"""yp AS (
  SELECT {key}, year, 'base' AS variant FROM a3 WHERE year = latest AND prev_complete
  UNION ALL SELECT {key}, year, 'peak' FROM a3 WHERE year = coalesce(peak_pub, peak_proxy) AND prev_complete
  UNION ALL SELECT {key}, year, 'published' FROM a3 WHERE year = pub_year
  UNION ALL SELECT {key}, year, 'base_weighted' FROM a3 WHERE year = latest AND prev_complete)""",
        f"""ywin AS (SELECT {key}, variant, side, y AS window_year,
    CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 10, 1), INTERVAL 3 MONTH)) AS DATE) AS period,
    4 AS expected
  FROM (SELECT {key}, variant, 'old' AS side, year - 1 AS y FROM yp
        UNION ALL SELECT {key}, variant, 'new', year FROM yp) AS s)""",
        f"""last AS (SELECT {key}, max(period) AS latest FROM panel GROUP BY {key})""",
        f"""rwin AS (
  SELECT {key}, variant, side, CAST(NULL AS BIGINT) AS window_year,
    CAST(unnest(generate_series(latest - to_months(3 * (ago + expected - 1)), latest - to_months(3 * ago),
                                INTERVAL 3 MONTH)) AS DATE) AS period, expected
  FROM last CROSS JOIN (VALUES ('trailing4', 'new', 0, 4), ('trailing4', 'old', 4, 4),
                               ('same2', 'new', 0, 2), ('same2', 'old', 4, 2)) AS v(variant, side, ago, expected))""",
        f"""st AS (SELECT *, w / bal * 100 * 4 / expected AS rate_pct FROM (
  SELECT p.{key}, variant, side, CAST(sum(write_offs) AS DOUBLE) AS w,
    CAST(sum(rollover) AS DOUBLE) / max(expected) AS bal, max(expected) AS expected,
    max(window_year) AS wy, min(p.period) AS p_first, max(p.period) AS p_last
  FROM panel p JOIN (SELECT * FROM ywin UNION ALL SELECT * FROM rwin) AS x
    ON p.{key} = x.{key} AND p.period = x.period
  GROUP BY ALL HAVING count(write_offs) = max(expected) AND count(rollover) = max(expected)) AS s0)""",
        f"""wide AS (SELECT {key}, variant, {wide_aggs} FROM st GROUP BY ALL HAVING count(*) = 2)""",
        f"""wide2 AS (SELECT wide.*, po.pub_rate_pct AS pub_old, pn.pub_rate_pct AS pub_new FROM wide
  LEFT JOIN published po ON po.{key} = wide.{key} AND po.year = wide.wy_old
  LEFT JOIN published pn ON pn.{key} = wide.{key} AND pn.year = wide.wy_new)""",
        f"""d AS (SELECT *, d_base * (rp0 + rp1) / 2 AS vol_p, (rp1 - rp0) * (bal_old + bal_new) / 2 AS rate_p
  FROM (SELECT *, pub_old / 100 AS rp0, pub_new / 100 AS rp1 FROM {b} AS bb) AS cc)""",
        """e AS (SELECT *,
    CASE variant WHEN 'published' THEN vol_p WHEN 'base_weighted' THEN volume_b ELSE volume END AS vv,
    CASE variant WHEN 'published' THEN rate_p WHEN 'base_weighted' THEN rate_b ELSE rate END AS rr,
    CASE variant WHEN 'published' THEN NULL WHEN 'base_weighted' THEN inter_b ELSE inter END AS jj,
    CAST(wy_old AS VARCHAR) AS yo, CAST(wy_new AS VARCHAR) AS yn
  FROM d)""") + f"""
SELECT {key}, variant AS variant_id, CAST(list_position([{variants}], variant) AS BIGINT) AS variant_order,
  variant || ': ' || win_new || ' against ' || win_old AS variant, win_old AS window_old, win_new AS window_new,
  w_old AS write_offs_old, w_new AS write_offs_new, d_w AS delta, vv AS volume, rr AS rate, jj AS joint,
  d_w - vv - rr - coalesce(jj, 0.0) AS residual,
  CASE WHEN variant = 'published' THEN pub_old ELSE rate_pct_old END AS rate_old_pct,
  CASE WHEN variant = 'published' THEN pub_new ELSE rate_pct_new END AS rate_new_pct
FROM (SELECT *,
    CASE WHEN variant IN ('published', 'base_weighted') THEN yo ELSE {span.format('p_first_old', 'p_last_old')} END AS win_old,
    CASE WHEN variant IN ('published', 'base_weighted') THEN yn ELSE {span.format('p_first_new', 'p_last_new')} END AS win_new
  FROM e) AS e2 WHERE variant <> 'published' OR (pub_old IS NOT NULL AND pub_new IS NOT NULL)"""


@register("sensitivity", sql=sql_finish(_sensitivity_sql(),
                                        keep=[_K, "variant_id", "variant_order", "variant", "window_old",
                                              "window_new"]))
def sensitivity_table(spark, sf_dir, panel=None):
    panel = FX.fact_panel(spark, sf_dir, SEG, line_level=False) if panel is None else panel
    return sensitivity(FX.with_published_rate(panel, SEG), SEG)


@register("sensitivity_customer", sql=sql_finish(_sensitivity_sql("o_custkey"),
          keep=["o_custkey", "variant_id", "variant_order", "variant", "window_old", "window_new"]))
def sensitivity_customer(spark, sf_dir):
    """The table of every customer: sparse panels, so most variants lack periods and are absent."""
    panel = FX.fact_panel(spark, sf_dir, CUST, line_level=False)
    return sensitivity(FX.with_published_rate(panel, CUST), CUST)


_WF_SQL = _with(*_BASE, f"""br AS (SELECT c_mktsegment, year, W AS write_offs, {_B['d_w']} AS delta_write_offs,
  {_B['volume']} AS volume, {_B['rate']} AS rate FROM pairs)""")


@register("waterfall_steps", sql=sql_finish(_WF_SQL + """
SELECT *, CASE WHEN step IN ('volume', 'rate') THEN least(running - value, running) ELSE 0.0 END AS bar_base,
  CASE WHEN step IN ('volume', 'rate') THEN greatest(running - value, running) ELSE value END AS bar_top
FROM (SELECT c_mktsegment, year, step, step_order, value,
        CASE WHEN step = 'end' THEN value
             ELSE sum(CASE WHEN step <> 'end' THEN value ELSE 0.0 END) OVER (
               PARTITION BY c_mktsegment, year ORDER BY step_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        END AS running
      FROM (SELECT c_mktsegment, year, 'start' AS step, CAST(1 AS BIGINT) AS step_order, write_offs - delta_write_offs AS value FROM br
            UNION ALL SELECT c_mktsegment, year, 'volume', 2, volume FROM br
            UNION ALL SELECT c_mktsegment, year, 'rate', 3, rate FROM br
            UNION ALL SELECT c_mktsegment, year, 'end', 4, write_offs FROM br) AS s) AS t""",
    keep=[_K, "year", "step", "step_order"]))
def waterfall_steps(spark, sf_dir):
    return C.waterfall(D.yearly_bridge(FX.fact_panel(spark, sf_dir, SEG, line_level=False), SEG), SEG)


@register("signed_stack", sql=sql_finish(_WF_SQL + """
SELECT c_mktsegment, year, part, part_order, value, bar_base, bar_base + value AS bar_top
FROM (SELECT *, CASE WHEN value >= 0
        THEN coalesce(sum(CASE WHEN value >= 0 THEN value END) OVER w, 0.0)
        ELSE coalesce(sum(CASE WHEN value < 0 THEN value END) OVER w, 0.0) END AS bar_base
      FROM (SELECT c_mktsegment, year, 'volume' AS part, CAST(1 AS BIGINT) AS part_order, volume AS value FROM br
            UNION ALL SELECT c_mktsegment, year, 'rate', 2, rate FROM br) AS s
      WINDOW w AS (PARTITION BY c_mktsegment, year ORDER BY part_order
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS t""",
    keep=[_K, "year", "part", "part_order"]))
def signed_stack(spark, sf_dir):
    return C.signed_stack(D.yearly_bridge(FX.fact_panel(spark, sf_dir, SEG, line_level=False), SEG), SEG)



def _pairs_sql(key: str) -> str:
    return _with(S.panel_cte([key]), S.annual_cte([key]), S.published_cte([key])) + f"""
SELECT {key}, year, year - 1 AS previous_year,
  CASE WHEN year = latest THEN 1 WHEN year = latest - 1 THEN 2 WHEN year = peak THEN 3 END AS priority,
  year = peak AS is_peak
FROM (SELECT *, coalesce(peak_pub, peak_proxy) AS peak FROM (
  SELECT a.{key}, a.year, lag(a.year) OVER (PARTITION BY a.{key} ORDER BY a.year) = a.year - 1 AS prev_complete,
    max(a.year) OVER w AS latest,
    arg_max(a.year, CASE WHEN p.pub_rate_pct IS NOT NULL THEN {{'r': p.pub_rate_pct, 'y': -a.year}} END) OVER w
      AS peak_pub,
    arg_max(a.year, {{'r': a.rate_pct_recomputed, 'y': -a.year}}) OVER w AS peak_proxy
  FROM annual a LEFT JOIN published p ON p.{key} = a.{key} AND p.year = a.year
  WINDOW w AS (PARTITION BY a.{key})) AS x) AS y
WHERE prev_complete AND (year = latest OR year = latest - 1 OR year = peak)"""


@register("comparison_pairs", sql=_pairs_sql("c_nationkey"))
def comparison_pairs(spark, sf_dir):
    """Latest, latest-1 and peak year pairs per nation, de-duplicated with
    priority (the peak often coincides with one of the first two)."""
    from ..operators.sensitivity import comparison_pairs as pairs
    keys = ["c_nationkey"]
    panel = FX.fact_panel(spark, sf_dir, keys, line_level=False, materialize=True)
    return pairs(panel, keys, FX.published_annual(panel, keys))


_VARIANT_VALUES = ", ".join(f"('{v}')" for v in VARIANTS)


@register("sensitivity_status", sql=f"""
SELECT e.o_custkey, v.variant_id, CASE WHEN s.variant_id IS NULL THEN 'pending' ELSE 'ok' END AS status
FROM (SELECT DISTINCT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS e
CROSS JOIN (VALUES {_VARIANT_VALUES}) AS v(variant_id)
LEFT JOIN ({_sensitivity_sql("o_custkey")}) AS s ON s.o_custkey = e.o_custkey AND s.variant_id = v.variant_id""")
def sensitivity_status(spark, sf_dir):
    """Which sensitivity rows exist per customer ('ok') and which are pending
    (the customer lacks consecutive complete years, eight quarters, or
    published rates for an adjacent pair)."""
    from ..operators.sensitivity import sensitivity_status as status
    keys = ["o_custkey"]
    panel = FX.fact_panel(spark, sf_dir, keys, line_level=False, materialize=True)
    return status(panel, keys, FX.published_annual(panel, keys))
