"""Reconciliation of the panel against an independent annual source.

Flows (billings, loss) are annual SUMS: the four quarters must add up to the
published figure within a tolerance. Stocks (balance, principal count) are
YEAR-END values: the published figure must equal the fourth-quarter value
exactly. Rates: recomputed annual rate vs the published one within 0.05 pt.
All comparisons are joins on (keys, year) plus one aggregate per entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import quarter_index
from ..spec import DEFAULT, PanelSpec
from .panel import annual_metrics, entity_window, with_year

RATE_TOL = 0.05     # percentage points
FLOW_TOL = 0.1


def rate_reconcile(panel: DataFrame, published: DataFrame, keys: Sequence[str],
                   spec: PanelSpec = DEFAULT, tol: float = RATE_TOL) -> DataFrame:
    """Per entity: max |recomputed - published| annual rate over comparable
    years, their count, and ``ok`` (at least one comparable year, within tol)."""
    a = annual_metrics(panel, keys, spec).select(*keys, "year", "rate_pct_recomputed")
    j = a.join(published.select(*keys, "year", "pub_rate_pct").where(F.col("pub_rate_pct").isNotNull()),
               [*keys, "year"], "inner")
    return (j.groupBy(*keys)
            .agg(F.max(F.abs(F.col("rate_pct_recomputed") - F.col("pub_rate_pct"))).alias("max_abs_diff"),
                 F.count(F.lit(1)).alias("comparable_years"))
            .withColumn("ok", (F.col("comparable_years") >= 1) & (F.col("max_abs_diff") <= tol)))


def quarterly_sums(panel: DataFrame, keys: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Complete years: summed flows and fourth-quarter stocks in one pass."""
    q4 = F.month(spec.period) == 10
    return (with_year(panel, spec).groupBy(*keys, "year")
            .agg(F.count(F.lit(1)).alias("_n"),
                 F.sum(spec.billings).cast("double").alias("q_billings"),
                 F.sum(spec.loss).cast("double").alias("q_write_offs"),
                 F.max(F.when(q4, F.col(spec.balance))).cast("double").alias("q4_rollover"),
                 F.max(F.when(q4, F.col(spec.principal))).cast("double").alias("q4_principal"))
            .where(F.col("_n") == 4).drop("_n"))


def flow_stock_reconcile(panel: DataFrame, published: DataFrame, keys: Sequence[str],
                         spec: PanelSpec = DEFAULT, flow_tol: float = FLOW_TOL) -> DataFrame:
    """Per entity over overlapping years (published has all four values):
    max flow gap (rounded to 9 dp), max stock gap, and both verdicts."""
    pub = published.where(F.col("pub_billings").isNotNull() & F.col("pub_write_offs").isNotNull()
                          & F.col("pub_rollover_ye").isNotNull() & F.col("pub_principal_ye").isNotNull())
    j = quarterly_sums(panel, keys, spec).join(pub, [*keys, "year"], "inner")
    flow_gap = F.greatest(F.abs(F.col("q_write_offs") - F.col("pub_write_offs")),
                          F.abs(F.col("q_billings") - F.col("pub_billings")))
    stock_gap = F.greatest(F.abs(F.col("q4_rollover") - F.col("pub_rollover_ye")),
                           F.abs(F.col("q4_principal") - F.col("pub_principal_ye")))
    return (j.groupBy(*keys)
            .agg(F.round(F.max(flow_gap), 9).alias("max_flow_gap"), F.max(stock_gap).alias("max_stock_gap"),
                 F.count(F.lit(1)).alias("overlap_years"))
            .withColumns({"flows_ok": (F.col("overlap_years") >= 1) & (F.col("max_flow_gap") <= flow_tol),
                          "stocks_ok": (F.col("overlap_years") >= 1) & (F.col("max_stock_gap") == 0)}))


def hand_check(panel: DataFrame, raw_annual: DataFrame, keys: Sequence[str],
               spec: PanelSpec = DEFAULT) -> DataFrame:
    """Independent recompute vs the staged metrics for every complete year.
    ``raw_annual`` has (keys, year, raw_w, raw_r) computed from the source
    facts without the panel. Full outer join, so a year present on one side
    only is reported (``ok`` false)."""
    a = annual_metrics(panel, keys, spec).select(*keys, "year", "write_offs", "avg_rollover",
                                                 "rate_pct_recomputed")
    j = a.join(raw_annual, [*keys, "year"], "full_outer")
    raw_rate = F.try_divide(F.col("raw_w"), F.col("raw_r")) * 100
    ok = ((F.abs(F.col("write_offs") - F.col("raw_w")) < 1e-6)
          & (F.abs(F.col("avg_rollover") - F.col("raw_r")) < 1e-6)
          & (F.abs(F.col("rate_pct_recomputed") - raw_rate) < 1e-9))
    return j.select(*keys, "year", "write_offs", "raw_w", "avg_rollover", "raw_r",
                    F.coalesce(ok, F.lit(False)).alias("ok"))


def coverage(panel: DataFrame, keys: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per entity: distinct years, complete years, whether complete years are
    contiguous and whether partial years sit only at the edges."""
    y = (with_year(panel, spec).groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("n"))
         .withColumn("complete", F.col("n") == 4))
    w = entity_window(keys)
    y = y.withColumns({"_cmin": F.min(F.when(F.col("complete"), F.col("year"))).over(w),
                       "_cmax": F.max(F.when(F.col("complete"), F.col("year"))).over(w)})
    return (y.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("years"), F.count_if("complete").alias("complete_years"),
                 F.min("_cmin").alias("first_complete"), F.max("_cmax").alias("last_complete"),
                 F.count_if(~F.col("complete") & (F.col("year") > F.col("_cmin"))
                            & (F.col("year") <= F.col("_cmax"))).alias("inner_partial_years"))
            .withColumns({
                "complete_contiguous": F.col("complete_years") == F.col("last_complete") - F.col("first_complete") + 1,
                "partial_at_edges": F.col("inner_partial_years") == 0}))


def source_overlap(panel: DataFrame, published: DataFrame, keys: Sequence[str],
                   spec: PanelSpec = DEFAULT) -> DataFrame:
    """Complete panel years without a usable published row (all five required
    values numeric): the years whose cross-check is still pending."""
    complete = (with_year(panel, spec).groupBy(*keys, "year")
                .agg(F.count_distinct(F.quarter(spec.period)).alias("nq"))
                .where(F.col("nq") == 4).drop("nq"))
    usable = published.where(F.col("pub_billings").isNotNull() & F.col("pub_write_offs").isNotNull()
                             & F.col("pub_rollover_ye").isNotNull() & F.col("pub_principal_ye").isNotNull()
                             & F.col("pub_rate_pct").isNotNull()).select(*keys, "year")
    return complete.join(usable, [*keys, "year"], "left_anti")


def reconcile_years(panel: DataFrame, annual: DataFrame, keys: Sequence[str], flows: dict[str, str], stocks: dict[str, str],
                    flow_tol: float = 0.1, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Source against source, per entity and year: ``annual`` (keys, series, year, value) as an annual file has it, against
    the quarters of ``panel``. ``flows`` and ``stocks``: series name -> panel column.

    A flow is compared with the sum of its four quarters, a stock with its fourth quarter. A row per entity and year of
    either source: largest gaps, series compared, and a status: ok, differs, or pending where a source lacks the year or
    a value. One aggregate over the cells of both sources; neither is pivoted."""
    quarters = with_year(panel, spec).groupBy(*keys, "year").agg(
        *[F.when(F.count(c) == 4, F.sum(c).cast("double")).alias(s) for s, c in flows.items()],
        *[F.max(F.when(F.quarter(spec.period) == 4, F.col(c))).cast("double").alias(s) for s, c in stocks.items()])
    names = [*flows, *stocks]
    cells = quarters.select(*keys, "year", F.inline(F.array(*[F.struct(F.lit(s).alias("series"), F.col(f"`{s}`").alias("q")) for s in names])))
    both = cells.withColumn("a", F.lit(None).cast("double")).unionByName(
        annual.where(F.col("series").isin(names)).select(*keys, "year", "series", F.lit(None).cast("double").alias("q"), F.col("value").alias("a")))
    per = both.groupBy(*keys, "year", "series").agg(F.max("q").alias("q"), F.max("a").alias("a"))
    gap, is_flow = F.abs(F.col("q") - F.col("a")), F.col("series").isin(list(flows))
    out = per.groupBy(*keys, "year").agg(
        F.count(gap).alias("compared"), F.max(F.when(is_flow, gap)).alias("flow_gap"), F.max(F.when(~is_flow, gap)).alias("stock_gap"))
    wrong = (F.coalesce("flow_gap", F.lit(0.0)) > flow_tol) | (F.coalesce("stock_gap", F.lit(0.0)) != 0)
    return out.withColumn("status", F.when(wrong, "differs").when(F.col("compared") == len(names), "ok").otherwise("pending"))


def audit_tables(panel: DataFrame, keys: Sequence[str], recent: int = 6, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The audit's tables in one pass over the panel: long rows (keys, section, subject, item, value).

    One window pass marks gaps and recent periods; then one aggregate with grouping sets has a row per entity and year,
    per entity and quarter of the year, per entity and recent period, and per entity. Sections: ``year`` (quarters, sums
    of the flows, averages and fourth quarters of the stocks, recomputed rate), ``quarter`` (mean rate over complete
    years), ``recent`` (the rate of the last ``recent`` periods) and ``entity`` (periods, gaps, and of every measure its
    least and greatest value and how many are missing). Values that need a full year are left out of a partial one."""
    p = spec.period
    w = entity_window(keys)
    index = quarter_index(p)
    marked = panel.withColumns({
        "_gap": index - F.lag(index).over(w.orderBy(p)) > 1, "year": F.year(p).cast("bigint"), "_q": F.quarter(p),
        "_full": F.count(F.lit(1)).over(w.partitionBy(*keys, F.year(p)) if keys else w.partitionBy(F.year(p))) == 4,
        "_recent": F.when(index > F.max(index).over(w) - recent, F.col(p))})
    names = spec.measure_names()
    k = ", ".join(f"`{c}`" for c in keys)
    sets = [f"({', '.join(x for x in (k, c) if x)})" for c in ("year", "_q", "_recent", "")]
    total = {m: f"CAST(CASE WHEN count(`{m}`) = 4 THEN sum(`{m}`) END AS DOUBLE)" for m in (spec.loss, spec.billings, spec.balance, spec.principal)}
    year = {"quarters": "CAST(count(*) AS DOUBLE)", f"sum {spec.loss}": total[spec.loss], f"sum {spec.billings}": total[spec.billings]}
    for m in (spec.balance, spec.principal):
        year[f"average {m}"] = f"{total[m]} / 4"
        year[f"fourth quarter {m}"] = f"CAST(max(CASE WHEN _q = 4 THEN `{m}` END) AS DOUBLE)"
    year["rate recomputed"] = f"try_divide(100 * {total[spec.loss]}, {total[spec.balance]} / 4)"
    entity = {"periods": "CAST(count(*) AS DOUBLE)", "gaps": "CAST(count_if(_gap) AS DOUBLE)"}
    for m in names:
        entity |= {f"least {m}": f"CAST(min(`{m}`) AS DOUBLE)", f"greatest {m}": f"CAST(max(`{m}`) AS DOUBLE)", f"missing {m}": f"CAST(count_if(`{m}` IS NULL) AS DOUBLE)"}
    sections = [
        ("year", "grouping(year) = 0", "CAST(year AS STRING)", year),
        ("quarter", "grouping(_q) = 0", "concat('Q', _q)", {"mean rate": f"CAST(avg(CASE WHEN _full THEN `{spec.rate}` END) AS DOUBLE)"}),
        ("recent", "grouping(_recent) = 0 AND _recent IS NOT NULL", "CAST(_recent AS STRING)", {"rate": f"CAST(max(`{spec.rate}`) AS DOUBLE)"}),
        ("entity", "grouping(year) + grouping(_q) + grouping(_recent) = 3", "''", entity)]

    def listed(name, subject, items):
        return "array(" + ", ".join(f"struct('{name}' AS section, {subject} AS subject, '{i}' AS item, {v} AS value)" for i, v in items.items()) + ")"

    cells = "CASE " + " ".join(f"WHEN {when} THEN {listed(n, s, items)}" for n, when, s, items in sections) + " END"
    grouped = panel.sparkSession.sql(f"SELECT {k + ', ' if k else ''}{cells} AS cells FROM {{marked}} GROUP BY GROUPING SETS ({', '.join(sets)})", marked=marked)
    return grouped.select(*keys, F.inline("cells")).where(F.col("value").isNotNull())
