"""Core driver queries: panel, annual metrics, yearly bridge.

Entity keys: ``SEG`` (market segment, 5 entities) for most queries, ``NAT``
(customer nation, 25 entities) where more entities help, ``CUST`` (customer,
sparse: gaps and NULL cells) for the data-quality queries, ``event_type`` for
the daily event panel. Every query reads the whole driver tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decompose as D
from ..operators import panel as P
from . import facts as FX
from . import sqlparts as S
from .edge import sql_finish
from .registry import SEG, register
from .registry import with_ctes as _with

# --------------------------------------------------------------------------- panel


@register("panel_quarterly", sql=sql_finish(
    _with(S.panel_cte(SEG)) +
    "SELECT c_mktsegment, period, principal, supplementary, CAST(billings AS DOUBLE) AS billings, "
    "CAST(rollover AS DOUBLE) AS rollover, CAST(write_offs AS DOUBLE) AS write_offs, rate_pct "
    "FROM panel WHERE period >= DATE '1995-01-01'",
    keep=["c_mktsegment", "period", "principal", "supplementary"]))
def panel_quarterly(spark, sf_dir, panel=None):
    """Facts -> (segment, quarter) panel from 1995 Q1 on; the date bound is a
    predicate on the order date, pushed into the orders Parquet scan. Or from
    a given panel of all quarters."""
    since = "1995-01-01"
    p = FX.fact_panel(spark, sf_dir, SEG, since=since) if panel is None else panel.where(F.col("period") >= F.lit(since).cast("date"))
    money_cols = {c: F.col(c).cast("double") for c in ("billings", "rollover", "write_offs")}
    return p.withColumns(money_cols)


@register("annual_metrics", sql=sql_finish(
    _with(S.panel_cte(SEG), S.annual_cte(SEG)) + "SELECT * FROM annual",
    keep=["c_mktsegment", "year", "quarters"]))
def annual_metrics(spark, sf_dir):
    return P.annual_metrics(FX.fact_panel(spark, sf_dir, SEG, line_level=False), SEG)


# --------------------------------------------------------------------------- bridge

def yearly_bridge_sql(key: str) -> str:
    keys = [key]
    return _with(
        S.panel_cte(keys), S.annual_cte(keys), S.published_cte(keys),
        f"""pairs AS (
  SELECT * FROM (
    SELECT {key}, year, write_offs AS W1, avg_rollover AS R1,
      lag(year) OVER (PARTITION BY {key} ORDER BY year) AS year0,
      lag(write_offs) OVER (PARTITION BY {key} ORDER BY year) AS W0,
      lag(avg_rollover) OVER (PARTITION BY {key} ORDER BY year) AS R0
    FROM annual) AS _l WHERE year = year0 + 1)""") + f"""
SELECT b.{key}, b.year, year0 AS previous_year, W1 AS write_offs, R1 AS avg_rollover,
  ratio1 * 100 * 4 / 4 AS rate_pct, d_w AS delta_write_offs, volume, rate, inter AS interaction,
  volume + rate + inter AS "check", {S.closes_expr()} AS closes,
  p.pub_rate_pct AS rate_pct_pub_annual,
  CASE WHEN p.pub_billings IS NOT NULL AND p.pub_write_offs IS NOT NULL AND p.pub_rollover_ye IS NOT NULL
        AND p.pub_principal_ye IS NOT NULL AND p.pub_rate_pct IS NOT NULL THEN 'checked' ELSE 'pending' END
    AS annual_crosscheck_status
FROM {S.bridge_select('W0', 'R0', 'W1', 'R1', 'pairs')} AS b
LEFT JOIN published p ON p.{key} = b.{key} AND p.year = b.year
"""


_YB_KEEP = ["year", "previous_year", "closes", "annual_crosscheck_status"]


@register("bridge_yearly", sql=sql_finish(yearly_bridge_sql("c_mktsegment"), keep=["c_mktsegment", *_YB_KEEP]))
def bridge_yearly(spark, sf_dir, panel=None):
    panel = FX.fact_panel(spark, sf_dir, SEG, line_level=False, materialize=True) if panel is None else panel
    return D.yearly_bridge(panel, SEG, FX.published_annual(panel, SEG))


@register("bridge_yearly_supplier", sql=sql_finish(yearly_bridge_sql("l_suppkey"), keep=["l_suppkey", *_YB_KEEP]))
def bridge_yearly_supplier(spark, sf_dir):
    """The flagship at scale: one entity per supplier (dense: every supplier
    has lines in every quarter), facts -> panel -> yearly bridge."""
    keys = ["l_suppkey"]
    panel = FX.fact_panel(spark, sf_dir, keys, materialize=True)
    return D.yearly_bridge(panel, keys, FX.published_annual(panel, keys))
