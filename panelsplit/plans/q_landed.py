"""Queries on landed sources and kept states: wide rows as maps, quarterly against annual files, hashes kept over
runs, and the audit's tables. What is written goes under the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import plain_text
from ..operators import profile as PF
from ..operators import reconcile as RC
from ..operators import reshape as RS
from ..session import cut_lineage, scratch_path
from ..sources import files as FS
from . import facts as FX
from . import sqlparts as S
from .edge import sql_finish
from .q_checks import _MAPPING, _WIDE_SERIES
from .q_files import _MEASURES, _PUB_SERIES, _newest_first
from .registry import CUST, SEG, register
from .registry import with_ctes as _with

_K = SEG[0]
_SEGP = S.panel_cte(SEG)
_CELLS = " + ".join(f"count({m})" for m in _MEASURES)
_ROWS = " + ".join(f"CAST(count({m}) > 0 AS INT)" for m in (*_MEASURES, "billings"))


@register("wide_maps", sql=_with(S.panel_cte(CUST)) + f"""
SELECT o_custkey, labels, raw_cells, raw_cells - present_cells AS missing_cells, present_cells, excluded_cells, CAST(0 AS BIGINT) AS rule_1,
  CAST(0 AS BIGINT) AS rule_2, excluded_cells AS rule_3, present_cells - excluded_cells AS staged_cells, labels AS staged_periods, TRUE AS reconciles
FROM (SELECT o_custkey, count(*) AS labels, count(*) * ({_ROWS}) AS raw_cells, {_CELLS} + count(billings) AS present_cells,
        count(billings) AS excluded_cells FROM panel GROUP BY o_custkey) AS x""")
def wide_maps(spark, sf_dir):
    """Customers, each with the quarters it has: wide rows as maps, staged back, and every cell accounted for."""
    panel = FX.fact_panel(spark, sf_dir, CUST, materialize=True)
    maps = RS.panel_to_maps(panel, CUST, _WIDE_SERIES)
    return RS.map_accounting(maps, RS.stage_maps(maps, CUST, _MAPPING), CUST, _MAPPING)


_FLOWS, _STOCKS = {"billings": "billings", "write_offs": "write_offs"}, {"rollover": "rollover", "principal": "principal"}


@register("landed_reconcile", sql=sql_finish(_with(_SEGP, S.published_cte(SEG), f"""ranked AS (SELECT {_K}, row_number() OVER (ORDER BY {_K}) AS rk FROM (SELECT DISTINCT {_K} FROM panel))""",
    f"""quarters AS (SELECT {_K}, year(period) AS year,
    CASE WHEN count(billings) = 4 THEN CAST(sum(billings) AS DOUBLE) END AS b, CASE WHEN count(write_offs) = 4 THEN CAST(sum(write_offs) AS DOUBLE) END AS w,
    max(CASE WHEN quarter(period) = 4 THEN CAST(rollover AS DOUBLE) END) AS r, max(CASE WHEN quarter(period) = 4 THEN CAST(principal AS DOUBLE) END) AS p
  FROM panel GROUP BY ALL)""", f"""landed AS (SELECT {_K}, year, pub_billings AS b,
    pub_write_offs + CASE WHEN rk = 1 AND year = 1994 THEN 1000 ELSE 0 END AS w,
    CASE WHEN rk = 2 AND year = 1995 THEN NULL ELSE pub_rollover_ye END AS r, pub_principal_ye AS p FROM published JOIN ranked USING ({_K}))""",
    f"""gaps AS (SELECT {_K}, year, abs(q.b - a.b) AS gb, abs(q.w - a.w) AS gw, abs(q.r - a.r) AS gr, abs(q.p - a.p) AS gp
  FROM quarters q FULL JOIN landed a USING ({_K}, year))""") + f"""
SELECT {_K}, year, CAST(gb IS NOT NULL AS INT) + CAST(gw IS NOT NULL AS INT) + CAST(gr IS NOT NULL AS INT) + CAST(gp IS NOT NULL AS INT) AS compared,
  round(greatest(gb, gw), 2) AS flow_gap, greatest(gr, gp) AS stock_gap,
  CASE WHEN coalesce(greatest(gb, gw), 0) > 0.1 OR coalesce(greatest(gr, gp), 0) <> 0 THEN 'differs'
       WHEN gb IS NOT NULL AND gw IS NOT NULL AND gr IS NOT NULL AND gp IS NOT NULL THEN 'ok' ELSE 'pending' END AS status
FROM gaps""", keep=[_K, "year", "compared", "status"]))
def landed_reconcile(spark, sf_dir):
    """Quarterly files against annual files, both read back as landed. One cell of an annual file is edited and one is
    missing: exactly that entity's year differs, and exactly the other's is pending."""
    base = scratch_path(spark, f"sources-{uuid.uuid4().hex}")
    panel = cut_lineage(FX.fact_panel(spark, sf_dir, SEG))
    FS.write_wide(_newest_first(RS.pivot_wide(RS.panel_to_long(panel, SEG, {m: m for m in _MEASURES}), SEG), [*SEG, "series"]), f"{base}/quarterly", _K)
    # From a pass of its own over the facts.
    published = FX.published_from_facts(spark, sf_dir, SEG)
    ranks = [r[0] for r in panel.select(_K).distinct().orderBy(_K).limit(2).collect()]
    edited = published.withColumns({
        "pub_write_offs": F.col("pub_write_offs") + F.when((F.col(_K) == ranks[0]) & (F.col("year") == 1994), 1000).otherwise(0),
        "pub_rollover_ye": F.when(~((F.col(_K) == ranks[1]) & (F.col("year") == 1995)), F.col("pub_rollover_ye"))}) if len(ranks) == 2 else published
    long = (edited.select(*SEG, F.col("year").cast("string").alias("label"), *[plain_text(c).alias(s) for s, c in _PUB_SERIES.items()])
            .unpivot([*SEG, "label"], list(_PUB_SERIES), "series", "value"))
    FS.write_wide(_newest_first(RS.pivot_wide(cut_lineage(long), SEG), [*SEG, "series"]), f"{base}/annual", _K, "na")
    quarterly = RS.stage_wide(FS.read_wide(spark, f"{base}/quarterly").drop("source_file"), SEG, {m: m for m in _MEASURES})
    annual = FS.read_annual_long(spark, f"{base}/annual", extra_ids=SEG)
    out = RC.reconcile_years(quarterly, annual, SEG, _FLOWS, _STOCKS)
    return out.select(*SEG, "year", "compared", F.round("flow_gap", 2).alias("flow_gap"), "stock_gap", "status")


@register("hash_history", sql=_with(S.panel_cte(CUST)) + """
SELECT run, rows, all_changed, changed_buckets, names_the_bucket
FROM (SELECT count(*) AS rows FROM panel) AS n,
  (VALUES (CAST(1 AS BIGINT), TRUE, CAST(NULL AS BIGINT), TRUE), (2, FALSE, 0, FALSE), (3, FALSE, 1, TRUE)) AS v(run, all_changed, changed_buckets, names_the_bucket)""")
def hash_history(spark, sf_dir):
    """Bucket hashes of the customer panel over three runs; the third has one cell changed, which one bucket shows."""
    path = f"{scratch_path(spark, f'hashes-{uuid.uuid4().hex}')}/table"
    panel = FX.fact_panel(spark, sf_dir, CUST, line_level=False, materialize=True)
    cell = panel.agg(F.min(F.struct("o_custkey", "period")).alias("c")).select("c.*").collect()[0]
    hit = (F.col("o_custkey") == cell["o_custkey"]) & (F.col("period") == F.lit(cell["period"]))
    changed = panel.withColumn("billings", F.when(hit, F.col("billings") + 1).otherwise(F.col("billings")))
    mine = F.pmod(F.xxhash64(F.lit(cell["o_custkey"]).cast("bigint")), F.lit(256))
    out = None
    for state in (panel, panel, changed):
        b = cut_lineage(PF.record_hashes(state, CUST, path, "customers"))
        row = b.groupBy("run").agg(F.sum("rows").alias("rows"), F.every("changed").alias("all_changed"), F.count_if("changed").alias("changed_buckets"),
                                   F.coalesce(F.max(F.when(F.col("bucket") == mine, F.col("changed"))), F.lit(False)).alias("names_the_bucket"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("changed_buckets", F.when(F.col("run") > 1, F.col("changed_buckets")))


def _audit_sql() -> str:
    def section(name, subject, items, source, where=""):
        return " UNION ALL ".join(f"SELECT {_K}, '{name}' AS section, {subject} AS subject, '{i}' AS item, CAST({v} AS DOUBLE) AS value FROM {source}{where}" for i, v in items.items())

    total = {m: f"CASE WHEN n_{m} = 4 THEN s_{m} END" for m in ("write_offs", "billings", "rollover", "principal")}
    year = {"quarters": "quarters", "sum write_offs": total["write_offs"], "sum billings": total["billings"],
            "average rollover": f"CAST({total['rollover']} AS DOUBLE) / 4", "fourth quarter rollover": "q4_rollover",
            "average principal": f"CAST({total['principal']} AS DOUBLE) / 4", "fourth quarter principal": "q4_principal",
            "rate recomputed": f"100 * CAST({total['write_offs']} AS DOUBLE) / (CAST({total['rollover']} AS DOUBLE) / 4)"}
    entity = {"periods": "periods", "gaps": "gaps"}
    for m in _MEASURES:
        entity |= {f"least {m}": f"lo_{m}", f"greatest {m}": f"hi_{m}", f"missing {m}": f"periods - n_{m}"}
    parts = [section("year", "CAST(year AS VARCHAR)", year, "years"), section("quarter", "'Q' || q", {"mean rate": "mean_rate"}, "seasons"),
             section("recent", "CAST(period AS VARCHAR)", {"rate": "rate_pct"}, "marked", " WHERE idx > latest - 6"), section("entity", "''", entity, "entities")]
    ctes = [_SEGP, f"""marked AS (SELECT *, year(period) * 4 + quarter(period) AS idx, max(year(period) * 4 + quarter(period)) OVER (PARTITION BY {_K}) AS latest,
    lag(year(period) * 4 + quarter(period)) OVER (PARTITION BY {_K} ORDER BY period) AS before, count(*) OVER (PARTITION BY {_K}, year(period)) AS in_year FROM panel)""",
            f"""years AS (SELECT {_K}, year(period) AS year, count(*) AS quarters, max(CASE WHEN quarter(period) = 4 THEN rollover END) AS q4_rollover,
    max(CASE WHEN quarter(period) = 4 THEN principal END) AS q4_principal, {", ".join(f"count({m}) AS n_{m}, sum({m}) AS s_{m}" for m in total)} FROM marked GROUP BY ALL)""",
            f"seasons AS (SELECT {_K}, quarter(period) AS q, avg(rate_pct) FILTER (WHERE in_year = 4) AS mean_rate FROM marked GROUP BY ALL)",
            f"""entities AS (SELECT {_K}, count(*) AS periods, count(*) FILTER (WHERE idx - before > 1) AS gaps,
    {", ".join(f"count({m}) AS n_{m}, min({m}) AS lo_{m}, max({m}) AS hi_{m}" for m in _MEASURES)} FROM marked GROUP BY ALL)"""]
    return sql_finish(_with(*ctes) + f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS t WHERE value IS NOT NULL", keep=[_K, "section", "subject", "item"])


@register("audit_tables", sql=_audit_sql())
def audit_tables(spark, sf_dir):
    """The audit of every segment: per year, per quarter of the year, recent quarters, and ranges, gaps and missing values."""
    return RC.audit_tables(FX.fact_panel(spark, sf_dir, SEG), SEG)
