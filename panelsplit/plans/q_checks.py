"""Quality checks, reconciliation, lookups, audit findings and wide staging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.periods import period_label
from ..operators import checks as K
from ..operators import reconcile as RC
from ..operators import reshape as RS
from ..operators.panel import entity_window
from ..session import cut_lineage
from . import facts as FX
from . import sqlparts as S
from .edge import sql_finish
from .registry import CUST, NAT, SEG, register
from .registry import with_ctes as _with

_K = "c_mktsegment"
_MEASURES = ["principal", "supplementary", "billings", "rollover", "write_offs", "rate_pct"]

# Fixed parameters of the check queries (data-appropriate bounds for the
# driver tables: orders span 1995-01 .. 2001-08).
FLOOR, AS_OF, MIN_PERIODS = "1995-01-01", "2000-12-31", 20


def _checks_sql(key: str, as_of: str = AS_OF) -> str:
    def rule(name, broken):
        return f"SELECT {key}, '{name}' AS check_name, count(*) FILTER (WHERE {broken}) AS violations FROM panel GROUP BY {key}"

    out = []
    for m in _MEASURES:
        x = f"CAST({m} AS DOUBLE)"
        out += [rule(f"{m}:missing", f"{m} IS NULL"), rule(f"{m}:not finite", f"NOT isfinite({x})")]
        if m in ("principal", "supplementary"):
            out.append(rule(f"{m}:not whole", f"isfinite({x}) AND {x} % 1 <> 0"))
        if m == "rate_pct":
            out.append(rule(f"{m}:out of bounds", f"isfinite({x}) AND {x} NOT BETWEEN 0 AND 50"))
        else:
            out.append(rule(f"{m}:not positive", f"{m} <= 0"))
    out.append(f"""SELECT {key}, 'period:repeated', count(*) FILTER (WHERE n > 1)
  FROM (SELECT {key}, period, count(*) AS n FROM panel GROUP BY ALL) AS r GROUP BY {key}""")
    out.append(f"""SELECT {key}, 'period:skipped', count(*) FILTER (WHERE period > prev + INTERVAL 3 MONTH)
  FROM (SELECT {key}, period, lag(period) OVER (PARTITION BY {key} ORDER BY period) AS prev
        FROM (SELECT DISTINCT {key}, period FROM panel) AS p) AS g GROUP BY {key}""")
    out.append(rule("period:outside the dates", f"period < DATE '{FLOOR}' OR period > DATE '{as_of}'"))
    out.append(f"SELECT {key}, 'period:too few', CAST(count(*) < {MIN_PERIODS} AS BIGINT) FROM panel GROUP BY {key}")
    return _with(S.panel_cte([key])) + " UNION ALL ".join(out)


@register("quality_checks", sql=_checks_sql("o_custkey"))
def quality_checks(spark, sf_dir):
    """All checks per customer on the sparse customer panel (gaps, NULL
    cells and short coverage occur naturally there): one window pass, one
    aggregate, stacked to long rows."""
    p = FX.fact_panel(spark, sf_dir, CUST)
    return K.quality_checks(p, CUST, floor=FLOOR, as_of=AS_OF, min_periods=MIN_PERIODS)


@register("quality_checks_segment", sql=_checks_sql(_K))
def quality_checks_segment(spark, sf_dir):
    """The same checks on the dense segment panel (expected clean except the
    range bound on the partial last year)."""
    p = FX.fact_panel(spark, sf_dir, SEG)
    return K.quality_checks(p, SEG, floor=FLOOR, as_of=AS_OF, min_periods=MIN_PERIODS)


def _damaged(panel):
    """A damaged twin of every segment ('damaged:<segment>') derived from the
    real panel by period rank: 1 fractional count, 2 NULL balance, 3 NaN rate,
    4 negative billings, 5 duplicated row, 6 removed (gap), 7 +Inf loss,
    8 rate above 50, 9 -Inf count."""
    from pyspark.sql import Window
    rk = F.row_number().over(Window.partitionBy(*SEG).orderBy("period"))
    d = panel.select(F.concat(F.lit("damaged:"), F.col(SEG[0])).alias(SEG[0]), "period",
                     *[F.col(m).cast("double").alias(m) for m in _MEASURES], rk.alias("rk"))
    d = d.withColumns({
        "principal": F.when(F.col("rk") == 1, F.col("principal") + 0.5)
                      .when(F.col("rk") == 9, F.lit(float("-inf"))).otherwise(F.col("principal")),
        "rollover": F.when(F.col("rk") == 2, F.lit(None).cast("double")).otherwise(F.col("rollover")),
        "rate_pct": F.when(F.col("rk") == 3, F.lit(float("nan")))
                     .when(F.col("rk") == 8, F.lit(60.0)).otherwise(F.col("rate_pct")),
        "billings": F.when(F.col("rk") == 4, -F.col("billings")).otherwise(F.col("billings")),
        "write_offs": F.when(F.col("rk") == 7, F.lit(float("inf"))).otherwise(F.col("write_offs")),
    })
    d = d.where(F.col("rk") != 6).unionByName(d.where(F.col("rk") == 5))
    clean = panel.select(*SEG, "period", *[F.col(m).cast("double").alias(m) for m in _MEASURES])
    return clean.unionByName(d.drop("rk"))


_DAMAGED_AS_OF = "2001-12-31"


@register("quality_checks_damaged", sql=_checks_sql(_K, _DAMAGED_AS_OF).replace(
    S.panel_cte([_K]), S.panel_cte([_K], name="base") + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY period) AS rk FROM base),
dmg AS (SELECT 'damaged:' || c_mktsegment AS c_mktsegment, period,
    CASE WHEN rk = 1 THEN CAST(principal AS DOUBLE) + 0.5 WHEN rk = 9 THEN '-Infinity'::DOUBLE
         ELSE CAST(principal AS DOUBLE) END AS principal,
    CAST(supplementary AS DOUBLE) AS supplementary,
    CASE WHEN rk = 4 THEN -CAST(billings AS DOUBLE) ELSE CAST(billings AS DOUBLE) END AS billings,
    CASE WHEN rk = 2 THEN NULL ELSE CAST(rollover AS DOUBLE) END AS rollover,
    CASE WHEN rk = 7 THEN 'Infinity'::DOUBLE ELSE CAST(write_offs AS DOUBLE) END AS write_offs,
    CASE WHEN rk = 3 THEN 'NaN'::DOUBLE WHEN rk = 8 THEN 60.0 ELSE rate_pct END AS rate_pct, rk
  FROM ranked),
panel AS (
  SELECT c_mktsegment, period, CAST(principal AS DOUBLE) AS principal, CAST(supplementary AS DOUBLE) AS supplementary,
    CAST(billings AS DOUBLE) AS billings, CAST(rollover AS DOUBLE) AS rollover,
    CAST(write_offs AS DOUBLE) AS write_offs, rate_pct FROM base
  UNION ALL SELECT * EXCLUDE (rk) FROM dmg WHERE rk <> 6
  UNION ALL SELECT * EXCLUDE (rk) FROM dmg WHERE rk = 5)"""))
def quality_checks_damaged(spark, sf_dir):
    """All checks on the segment panel plus its damaged twins: every
    kind of check except coverage must fire on the twins and only there."""
    panel = FX.fact_panel(spark, sf_dir, SEG, materialize=True)
    return K.quality_checks(_damaged(panel), SEG, floor=FLOOR, as_of=_DAMAGED_AS_OF, min_periods=MIN_PERIODS)


_PUB = [S.panel_cte(SEG), S.annual_cte(SEG), S.published_cte(SEG)]

# The segments, and a twin of each whose published table is wrong and must fail.
_PUB_TWINS = [
    S.panel_cte(SEG, name="panel0"),
    f"panel AS (SELECT * FROM panel0 UNION ALL SELECT * REPLACE ('damaged:' || {_K} AS {_K}) FROM panel0)",
    S.annual_cte(SEG), S.published_cte(SEG, name="published0"),
    f"""published AS (SELECT * FROM published0 UNION ALL
  SELECT * REPLACE ('damaged:' || {_K} AS {_K}, pub_rate_pct + 1 AS pub_rate_pct, pub_write_offs * 2 AS pub_write_offs,
                    pub_rollover_ye + 1 AS pub_rollover_ye) FROM published0)"""]


def _with_twins(spark, sf_dir):
    """Panel and published table (each from its own pass over the facts) with their damaged twins."""
    def twin(df, **changes):
        # Every aggregated row becomes itself and its twin: the facts below are read once.
        changes = {SEG[0]: F.concat(F.lit("damaged:"), F.col(SEG[0])), **changes}
        both = df.withColumn("_damaged", F.explode(F.array(F.lit(False), F.lit(True))))
        return both.withColumns({c: F.when(F.col("_damaged"), x).otherwise(F.col(c)) for c, x in changes.items()}).drop("_damaged")

    panel = twin(FX.fact_panel(spark, sf_dir, SEG, line_level=False))
    published = twin(FX.published_from_facts(spark, sf_dir, SEG), pub_rate_pct=F.col("pub_rate_pct") + 1,
                     pub_write_offs=F.col("pub_write_offs") * 2, pub_rollover_ye=F.col("pub_rollover_ye") + 1)
    return panel, published


@register("rate_reconcile", sql=sql_finish(_with(*_PUB_TWINS) + """
SELECT *, comparable_years >= 1 AND max_abs_diff <= 0.05 AS ok FROM (
  SELECT a.c_mktsegment, max(abs(rate_pct_recomputed - pub_rate_pct)) AS max_abs_diff, count(*) AS comparable_years
  FROM annual a JOIN published p ON p.c_mktsegment = a.c_mktsegment AND p.year = a.year
  WHERE pub_rate_pct IS NOT NULL GROUP BY a.c_mktsegment) AS x""", keep=[_K, "comparable_years", "ok"]))
def rate_reconcile(spark, sf_dir):
    p, published = _with_twins(spark, sf_dir)
    return RC.rate_reconcile(p, published, SEG)


@register("flow_stock_reconcile", sql=sql_finish(_with(*_PUB_TWINS) + """
SELECT *, overlap_years >= 1 AND max_flow_gap <= 0.1 AS flows_ok, overlap_years >= 1 AND max_stock_gap = 0 AS stocks_ok
FROM (SELECT q.c_mktsegment,
        round(max(greatest(abs(q_write_offs - pub_write_offs), abs(q_billings - pub_billings))), 9) AS max_flow_gap,
        max(greatest(abs(q4_rollover - pub_rollover_ye), abs(q4_principal - pub_principal_ye))) AS max_stock_gap,
        count(*) AS overlap_years
      FROM (SELECT c_mktsegment, CAST(year(period) AS BIGINT) AS year,
              CAST(sum(billings) AS DOUBLE) AS q_billings, CAST(sum(write_offs) AS DOUBLE) AS q_write_offs,
              CAST(max(CASE WHEN month(period) = 10 THEN rollover END) AS DOUBLE) AS q4_rollover,
              CAST(max(CASE WHEN month(period) = 10 THEN principal END) AS DOUBLE) AS q4_principal
            FROM panel GROUP BY ALL HAVING count(*) = 4) AS q
      JOIN published p ON p.c_mktsegment = q.c_mktsegment AND p.year = q.year
      WHERE pub_billings IS NOT NULL AND pub_write_offs IS NOT NULL AND pub_rollover_ye IS NOT NULL
        AND pub_principal_ye IS NOT NULL
      GROUP BY q.c_mktsegment) AS x""", keep=[_K, "overlap_years", "flows_ok", "stocks_ok"]))
def flow_stock_reconcile(spark, sf_dir):
    p, published = _with_twins(spark, sf_dir)
    return RC.flow_stock_reconcile(p, published, SEG)


@register("hand_check", sql=sql_finish(_with(*_PUB) + """
SELECT coalesce(a.c_mktsegment, r.c_mktsegment) AS c_mktsegment, coalesce(a.year, r.year) AS year,
  a.write_offs, r.raw_w, a.avg_rollover, r.raw_r,
  coalesce(abs(a.write_offs - r.raw_w) < 1e-6 AND abs(a.avg_rollover - r.raw_r) < 1e-6
           AND abs(a.rate_pct_recomputed - r.raw_w / r.raw_r * 100) < 1e-9, false) AS ok
FROM annual a FULL OUTER JOIN (
  SELECT c_mktsegment, year, CAST(w AS DOUBLE) AS raw_w, CAST(rb AS DOUBLE) / 4 AS raw_r
  FROM published_raw WHERE nq = 4) AS r
  ON r.c_mktsegment = a.c_mktsegment AND r.year = a.year""", keep=[_K, "year", "ok"]))
def hand_check(spark, sf_dir):
    """Every complete year recomputed straight from the facts (no panel)
    against the staged annual metrics; a year on one side only fails."""
    p = FX.fact_panel(spark, sf_dir, SEG, line_level=False)
    return RC.hand_check(p, FX.raw_annual(spark, sf_dir, SEG), SEG)


@register("coverage_check", sql=_with(S.panel_cte(SEG)) + """
SELECT *, complete_years = last_complete - first_complete + 1 AS complete_contiguous,
  inner_partial_years = 0 AS partial_at_edges
FROM (SELECT c_mktsegment, count(*) AS years, count(*) FILTER (WHERE complete) AS complete_years,
        min(cmin) AS first_complete, max(cmax) AS last_complete,
        count(*) FILTER (WHERE NOT complete AND year > cmin AND year <= cmax) AS inner_partial_years
      FROM (SELECT *, min(CASE WHEN complete THEN year END) OVER w AS cmin,
              max(CASE WHEN complete THEN year END) OVER w AS cmax
            FROM (SELECT c_mktsegment, CAST(year(period) AS BIGINT) AS year, count(*) = 4 AS complete
                  FROM panel GROUP BY ALL) AS y
            WINDOW w AS (PARTITION BY c_mktsegment)) AS z
      GROUP BY c_mktsegment) AS x""")
def coverage_check(spark, sf_dir):
    return RC.coverage(FX.fact_panel(spark, sf_dir, SEG, line_level=False), SEG)


@register("source_overlap", sql=_with(*_PUB, """usable AS (SELECT * FROM published
  WHERE pub_billings IS NOT NULL AND pub_write_offs IS NOT NULL AND pub_rollover_ye IS NOT NULL
    AND pub_principal_ye IS NOT NULL AND pub_rate_pct IS NOT NULL)""",
                                           """lagged AS (SELECT c_mktsegment, year FROM (
  SELECT *, max(year) OVER (PARTITION BY c_mktsegment) AS last FROM usable) AS u WHERE year < last)""") + """
SELECT c_mktsegment, year FROM (
  SELECT c_mktsegment, CAST(year(period) AS BIGINT) AS year FROM panel GROUP BY ALL
  HAVING count(DISTINCT quarter(period)) = 4) AS c
ANTI JOIN lagged l USING (c_mktsegment, year)""")
def source_overlap(spark, sf_dir):
    """The published source lags one year (its latest usable year withheld):
    the complete panel years whose cross-check is pending."""
    p = FX.fact_panel(spark, sf_dir, SEG, line_level=False, materialize=True)
    pub = FX.published_annual(p, SEG)
    usable = pub.where(F.col("pub_billings").isNotNull() & F.col("pub_write_offs").isNotNull()
                       & F.col("pub_rollover_ye").isNotNull() & F.col("pub_principal_ye").isNotNull()
                       & F.col("pub_rate_pct").isNotNull())
    lagged = (usable.withColumn("_last", F.max("year").over(entity_window(SEG)))
              .where(F.col("year") < F.col("_last")).drop("_last"))
    return RC.source_overlap(p, lagged, SEG)


FRESH_AS_OF = "2002-03-31"


@register("freshness", sql=_with(S.panel_cte(SEG)) + f"""
SELECT *, latest_index >= floor_index AS fresh FROM (
  SELECT c_mktsegment, max(year(period) * 4 + quarter(period)) AS latest_index,
    year(DATE '{FRESH_AS_OF}') * 4 + quarter(DATE '{FRESH_AS_OF}') - 2 AS floor_index
  FROM panel GROUP BY c_mktsegment) AS x""")
def freshness(spark, sf_dir):
    p = FX.fact_panel(spark, sf_dir, SEG, line_level=False)
    return K.freshness(p, SEG, FRESH_AS_OF).select(
        *SEG, F.col("latest_index").cast("bigint").alias("latest_index"),
        F.col("floor_index").cast("bigint").alias("floor_index"), "fresh")


@register("lookup_default", sql=sql_finish(_with(S.panel_cte(SEG), """lab AS (
  SELECT *, CAST(year(period) AS VARCHAR) || ' Q' || CAST(quarter(period) AS VARCHAR) AS label FROM panel)""",
                                                 """sel AS (
  SELECT c_mktsegment, label AS selection FROM lab
  UNION ALL SELECT c_mktsegment, CAST(year(nxt) AS VARCHAR) || ' Q' || CAST(quarter(nxt) AS VARCHAR)
  FROM (SELECT c_mktsegment, CAST(max(period) + INTERVAL 3 MONTH AS DATE) AS nxt FROM panel GROUP BY ALL) AS m)""") + """
SELECT s.c_mktsegment, s.selection, l.period IS NOT NULL AS valid,
  CASE WHEN l.period IS NULL THEN 'Invalid quarter' ELSE 'ok' END AS status,
  l.write_offs, l.rollover, l.billings, l.rate_pct
FROM sel s LEFT JOIN lab l ON l.c_mktsegment = s.c_mktsegment AND l.label = s.selection""",
    keep=[_K, "selection", "valid", "status"]))
def lookup_default(spark, sf_dir):
    """Look up each selected period label (every panel label plus the
    quarter after the last one) with a default for unknown labels."""
    p = FX.fact_panel(spark, sf_dir, SEG, line_level=False, materialize=True).withColumn("label", period_label("period"))
    nxt = p.groupBy(*SEG).agg(F.add_months(F.max("period"), 3).alias("nxt"))
    sel = p.select(*SEG, F.col("label").alias("selection")).unionByName(
        nxt.select(*SEG, period_label("nxt").alias("selection")))
    j = sel.join(p.withColumnRenamed("label", "selection"), [*SEG, "selection"], "left")
    return j.select(*SEG, "selection", F.col("period").isNotNull().alias("valid"),
                    F.when(F.col("period").isNull(), F.lit("Invalid quarter")).otherwise(F.lit("ok")).alias("status"),
                    "write_offs", "rollover", "billings", "rate_pct")


# --------------------------------------------------------------------------- wide staging

# Series of the wide file built from the nation panel: the six mapped series
# plus one that is not in the mapping (excluded by the 'unexpected series' rule).
_MAPPING = {m: m for m in _MEASURES}
_WIDE_SERIES = {**_MAPPING, "orders_value": "billings"}


def _wide(spark, sf_dir):
    # The pivot runs two jobs (label discovery, then the pivot): checkpoint the
    # panel into the shared folder so the facts are aggregated once.
    p = cut_lineage(FX.fact_panel(spark, sf_dir, NAT))
    return RS.pivot_wide(RS.panel_to_long(p, NAT, _WIDE_SERIES), NAT)


_NATP = S.panel_cte(NAT)


@register("unpivot_stage", sql=sql_finish(_with(_NATP) + """
SELECT c_nationkey, period, CAST(principal AS DOUBLE) AS principal, CAST(supplementary AS DOUBLE) AS supplementary,
  CAST(billings AS DOUBLE) AS billings, CAST(rollover AS DOUBLE) AS rollover,
  CAST(write_offs AS DOUBLE) AS write_offs, rate_pct
FROM panel""", keep=["c_nationkey", "period"]))
def unpivot_stage(spark, sf_dir):
    """Panel -> wide rows (one per nation and series, a map from quarter label
    to value) -> staged back: explode, label/value/series filters, parse,
    pivot. Must reproduce the panel exactly; one job, labels are not collected."""
    panel = FX.fact_panel(spark, sf_dir, NAT)
    return RS.stage_maps(RS.panel_to_maps(panel, NAT, _WIDE_SERIES), NAT, _MAPPING)


@register("cell_accounting", sql=_with(_NATP, """cells AS (
  SELECT c_nationkey, count(principal) + count(supplementary) + count(billings) + count(rollover)
    + count(write_offs) + count(rate_pct) AS staged, count(billings) AS extra, count(*) AS periods
  FROM panel GROUP BY c_nationkey)""", """grid AS (SELECT count(DISTINCT period) AS labels FROM panel)""") + f"""
SELECT c_nationkey, 7 * labels AS raw_cells, 7 * labels - staged - extra AS missing_cells,
  staged + extra AS present_cells, extra AS excluded_cells, CAST(0 AS BIGINT) AS rule_1, CAST(0 AS BIGINT) AS rule_2,
  extra AS rule_3, staged AS staged_cells, periods AS staged_periods,
  staged + extra + (7 * labels - staged - extra) = 7 * labels AS reconciles
FROM cells, grid""")
def cell_accounting(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    staged = RS.stage_wide(wide, NAT, _MAPPING)
    return RS.cell_accounting(wide, staged, NAT, _MAPPING).withColumn(
        "raw_cells", F.col("raw_cells").cast("bigint"))

