"""Per-entity window metrics and small aggregates over a panel.

Every window is ``partitionBy(keys)``: an entity holds one row per period, so a
window task is bounded by the number of periods, never by the fact volume.
Several metrics over the same window spec are evaluated in one ``Window``
operator (one sort per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import full_avg, full_sum, pct_change, ratio
from ..functions.periods import period_label, quarter_index
from ..spec import DEFAULT, PanelSpec
from .panel import annual_metrics, entity_window, with_year


def trailing_sum(panel: DataFrame, keys: Sequence[str], col: str, n: int = 4,
                 spec: PanelSpec = DEFAULT, name: str | None = None,
                 index: Column | None = None) -> DataFrame:
    """Trailing n-period sum, only on windows with n values (NULL otherwise: a period
    without a value leaves the window short, as it leaves a year incomplete).

    Adds ``{name}`` (ROWS window: the last n rows) and ``{name}_contiguous``
    (RANGE window over the calendar index - quarter index by default, pass
    e.g. a day number for daily panels - NULL when a gap or a NULL leaves fewer than n
    values in it)."""
    name = name or f"{col}_{n}q"
    base = entity_window(keys)
    by_rows = base.orderBy(spec.period).rowsBetween(-(n - 1), 0)
    idx = index if index is not None else quarter_index(spec.period)
    by_range = base.orderBy(idx).rangeBetween(-(n - 1), 0)
    return panel.withColumns({
        name: F.when(F.count(col).over(by_rows) == n, F.sum(col).over(by_rows)),
        f"{name}_contiguous": F.when(F.count(col).over(by_range) == n, F.sum(col).over(by_range)),
    })


def sequence_number(panel: DataFrame, keys: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """``seq`` = 1 for the oldest period of each entity."""
    return panel.withColumn("seq", F.row_number().over(entity_window(keys).orderBy(spec.period)))


def trailing_by_sequence(panel: DataFrame, keys: Sequence[str], col: str, n: int = 4,
                         spec: PanelSpec = DEFAULT) -> DataFrame:
    """The conditional-sum formulation of the trailing window: each row
    contributes to sequence numbers seq..seq+n-1, an aggregate on (keys,
    target) sums the contributions, an equi-join brings them back. Bounded
    fan-out n per row; no range join, no pairs."""
    seq = sequence_number(panel, keys, spec)
    contrib = (seq.select(*keys, F.explode(F.sequence(F.col("seq"), F.col("seq") + (n - 1))).alias("seq"),
                          F.col(col).alias("_v"))
               .groupBy(*keys, "seq").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n")))
    return (seq.join(contrib, [*keys, "seq"], "left")
            .withColumn(f"{col}_{n}q_by_seq", F.when(F.col("_n") == n, F.col("_s")))
            .drop("_s", "_n"))


def yoy_change(panel: DataFrame, keys: Sequence[str], col: str, lag: int = 4,
               spec: PanelSpec = DEFAULT) -> DataFrame:
    """``{col}_yoy`` = value - value `lag` rows earlier (NULL with less
    history); ``{col}_yoy_checked`` also requires that row to be exactly
    `lag` quarters earlier."""
    w = entity_window(keys).orderBy(spec.period)
    prev = F.lag(col, lag).over(w)
    prev_idx = F.lag(quarter_index(spec.period), lag).over(w)
    return panel.withColumns({
        f"{col}_yoy": F.col(col) - prev,
        f"{col}_yoy_checked": F.when(quarter_index(spec.period) - prev_idx == lag, F.col(col) - prev),
    })


def first_full_window(panel: DataFrame, keys: Sequence[str], col: str, n: int = 4,
                      spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per entity: the first sequence number / period with a full n-window."""
    t = sequence_number(trailing_sum(panel, keys, col, n, spec, name="_t"), keys, spec)
    return (t.groupBy(*keys)
            .agg(F.min(F.when(F.col("_t").isNotNull(), F.col("seq"))).alias("first_full_seq"),
                 F.min(F.when(F.col("_t").isNotNull(), F.col(spec.period))).alias("first_full_period"),
                 F.count(F.lit(1)).alias("periods")))


def recent_periods(panel: DataFrame, keys: Sequence[str], back: int = 4,
                   spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows whose quarter index is within ``back`` quarters of the entity's
    latest (index >= latest - back + 1), with index and display label."""
    idx = quarter_index(spec.period)
    w = entity_window(keys)
    return (panel.withColumns({"period_index": idx, "period_label": period_label(spec.period),
                               "_latest": F.max(idx).over(w)})
            .where(F.col("period_index") >= F.col("_latest") - (back - 1)).drop("_latest"))


def seasonal_means(panel: DataFrame, keys: Sequence[str], col: str,
                   spec: PanelSpec = DEFAULT) -> DataFrame:
    """Pooled quarter-of-year mean of ``col`` over complete years."""
    complete = annual_metrics(panel, keys, spec).select(*keys, "year")
    return (with_year(panel, spec).join(complete, [*keys, "year"], "left_semi")
            .groupBy(*keys, F.quarter(spec.period).cast("bigint").alias("quarter_of_year"))
            .agg((F.sum(col).cast("double") / F.count(col)).alias(f"mean_{col}"),
                 F.count(col).alias("years")))


def long_measures(panel: DataFrame, keys: Sequence[str], measures: Sequence[str],
                  spec: PanelSpec = DEFAULT) -> DataFrame:
    """(keys, period, series, value DOUBLE) — NULL cells kept."""
    cast = panel.select(*keys, spec.period, *[F.col(m).cast("double").alias(m) for m in measures])
    return cast.unpivot([*keys, spec.period], list(measures), "series", "value")


def series_profile(panel: DataFrame, keys: Sequence[str], measures: Sequence[str],
                   spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per entity and series: min, max, NULL count, first and last period."""
    lng = long_measures(panel, keys, measures, spec)
    return (lng.groupBy(*keys, "series")
            .agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"),
                 F.count_if(F.col("value").isNull()).alias("nulls"),
                 F.count(F.lit(1)).alias("periods"),
                 F.min(spec.period).alias("first_period"), F.max(spec.period).alias("last_period")))


def largest_move(panel: DataFrame, keys: Sequence[str], col: str,
                 spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per entity: the largest one-period move |v_t - v_{t-1}| (ties: the
    later period), its endpoints and % change. Arg-max by ``max_by`` on a
    struct key (deterministic; no sort of the partition)."""
    w = entity_window(keys).orderBy(spec.period)
    moves = (panel.select(*keys, spec.period, F.col(col).cast("double").alias("v"))
             .withColumns({"p0": F.lag(spec.period).over(w), "v0": F.lag("v").over(w)})
             .where(F.col("p0").isNotNull() & F.col("v").isNotNull() & F.col("v0").isNotNull()))
    best = F.max_by(F.struct("p0", spec.period, "v0", "v"),
                    F.struct(F.abs(F.col("v") - F.col("v0")), F.col("p0")))
    return (moves.groupBy(*keys).agg(best.alias("m"))
            .select(*keys, F.col("m.p0").alias("from_period"), F.col(f"m.{spec.period}").alias("to_period"),
                    F.col("m.v0").alias("from_value"), F.col("m.v").alias("to_value"),
                    (F.col("m.v") - F.col("m.v0")).alias("change"),
                    pct_change(F.col("m.v"), F.col("m.v0")).alias("change_pct")))


def annual_average(panel: DataFrame, keys: Sequence[str], col: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Average of ``col`` per complete year (four periods)."""
    return (with_year(panel, spec).groupBy(*keys, "year")
            .agg(F.count(F.lit(1)).alias("_n"), full_avg(col, 4).alias("avg_value"))
            .where(F.col("_n") == 4).drop("_n"))


def decline_count(panel: DataFrame, keys: Sequence[str], col: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per entity over complete years: the count of years whose annual
    average fell versus the year before, and the endpoint change."""
    a = annual_average(panel, keys, col, spec)
    w = entity_window(keys).orderBy("year")
    a = a.withColumns({"_prev": F.lag("avg_value").over(w), "_py": F.lag("year").over(w)})
    return (a.groupBy(*keys)
            .agg(F.count_if((F.col("year") == F.col("_py") + 1) & (F.col("avg_value") < F.col("_prev")))
                 .alias("declining_years"),
                 F.count_if(F.col("year") == F.col("_py") + 1).alias("year_pairs"),
                 F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                 F.min_by("avg_value", "year").alias("first_value"),
                 F.max_by("avg_value", "year").alias("last_value"))
            .withColumn("endpoint_change_pct", pct_change("last_value", "first_value")))


def peak_period(panel: DataFrame, keys: Sequence[str], published: DataFrame | None = None,
                spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per entity: the peak complete year by published annual rate (earliest
    year on ties), falling back to the recomputed rate when no published rate
    exists; plus the period with the largest loss (earliest on ties)."""
    annual = annual_metrics(panel, keys, spec).select(*keys, "year", "rate_pct_recomputed")
    if published is not None:
        annual = annual.join(published.select(*keys, "year", "pub_rate_pct"), [*keys, "year"], "left")
    else:
        annual = annual.withColumn("pub_rate_pct", F.lit(None).cast("double"))
    has_pub = F.col("pub_rate_pct").isNotNull()
    agg = annual.groupBy(*keys).agg(
        F.max_by("year", F.when(has_pub, F.struct(F.col("pub_rate_pct"), -F.col("year")))).alias("peak_pub"),
        F.max_by("year", F.struct(F.col("rate_pct_recomputed"), -F.col("year"))).alias("peak_proxy"),
        F.count_if(has_pub).alias("published_years"))
    top = (panel.where(F.col(spec.loss).isNotNull()).groupBy(*keys)
           .agg(F.max_by(spec.period, F.struct(F.col(spec.loss), -F.datediff(spec.period, F.lit("1970-01-01"))))
                .alias("max_loss_period"),
                F.max(F.col(spec.loss).cast("double")).alias("max_loss")))
    peak = agg.select(*keys, F.coalesce("peak_pub", "peak_proxy").alias("peak_year"),
                      F.when(F.col("published_years") > 0, F.lit("published")).otherwise(F.lit("proxy"))
                      .alias("peak_basis"))
    if keys:
        return peak.join(top, list(keys), "left")
    # whole table: both sides are single-row aggregates, paired on a constant
    one = F.lit(1).alias("_all")
    return peak.select("*", one).join(top.select("*", one), "_all", "left").drop("_all")


def rate_path(panel: DataFrame, keys: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Latest complete year per entity with the recomputed rate of it and the
    two years before, and both one-year steps (requires consecutive years)."""
    a = annual_metrics(panel, keys, spec).select(*keys, "year", F.col("rate_pct_recomputed").alias("r"))
    w = entity_window(keys).orderBy("year")
    a = a.withColumns({"r1": F.lag("r", 1).over(w), "r2": F.lag("r", 2).over(w),
                       "y1": F.lag("year", 1).over(w), "y2": F.lag("year", 2).over(w),
                       "_last": F.max("year").over(entity_window(keys))})
    return (a.where((F.col("year") == F.col("_last")) & (F.col("y1") == F.col("year") - 1)
                    & (F.col("y2") == F.col("year") - 2))
            .select(*keys, "year", F.col("r2").alias("rate_two_before"), F.col("r1").alias("rate_before"),
                    F.col("r").alias("rate_latest"), (F.col("r1") - F.col("r2")).alias("step_before"),
                    (F.col("r") - F.col("r1")).alias("step_latest")))


def per_unit(panel: DataFrame, keys: Sequence[str], spec: PanelSpec = DEFAULT,
             unit_scale: float = 1e6) -> DataFrame:
    """Per complete year: loss per principal unit (sum loss * unit_scale / average
    principal count), its year-on-year % change, balance per unit and the
    balance-to-billings ratio. ``unit_scale`` converts the money unit
    (1e6 when money is in millions, 1.0 when it is in units)."""
    y = (with_year(panel, spec).groupBy(*keys, "year")
         .agg(F.count(F.lit(1)).alias("_n"), full_sum(spec.loss, 4).alias("w"),
              full_avg(spec.principal, 4).alias("p"), full_avg(spec.supplementary, 4).alias("s"),
              full_avg(spec.balance, 4).alias("r"), full_avg(spec.billings, 4).alias("b"))
         .where(F.col("_n") == 4))
    w = entity_window(keys).orderBy("year")
    y = y.withColumn("loss_per_principal", F.try_divide(F.col("w") * F.lit(unit_scale), F.col("p")))
    return (y.withColumns({"_prev": F.lag("loss_per_principal").over(w), "_py": F.lag("year").over(w)})
            .select(*keys, "year", "loss_per_principal",
                    F.when(F.col("_py") == F.col("year") - 1, pct_change("loss_per_principal", "_prev"))
                    .alias("loss_per_principal_change_pct"),
                    F.try_divide(F.col("r") * F.lit(unit_scale), F.col("p") + F.col("s")).alias("balance_per_unit"),
                    ratio("r", "b").alias("balance_to_billings")))

