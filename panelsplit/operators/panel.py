"""Facts -> panel, and panel -> complete-year aggregates.

Partitioning: ``build_panel`` is one hash aggregate on ``(keys, period)`` with
map-side partial aggregation (a hot entity collapses to one row per period per
map task before the shuffle). ``cluster_by_entity`` then hash-partitions the
(small) panel by ``keys`` only; later groupBys on ``(keys, year)`` and windows
``partitionBy(keys)`` are satisfied by that partitioning and add no exchange.
Joins on ``(keys, year)`` do.
An entity holds at most one row per period, so this partitioning cannot skew
beyond the number of periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import full_avg, full_sum, ratio
from ..spec import DEFAULT, PanelSpec


def entity_window(keys: Sequence[str]) -> Window:
    """Window partitioned by the entity keys (whole-table only when keys is empty)."""
    return Window.partitionBy(*keys) if keys else Window.partitionBy()


def build_panel(facts: DataFrame, keys: Sequence[str], period: Column,
                aggs: dict[str, Column], post: dict[str, Column] | None = None,
                period_name: str = "period") -> DataFrame:
    """One row per (keys, period): ``aggs`` are aggregate expressions over the
    facts, ``post`` are expressions over the aggregated columns."""
    out = (facts.groupBy(*[F.col(k) for k in keys], period.alias(period_name))
           .agg(*[expr.alias(name) for name, expr in aggs.items()]))
    if post:
        out = out.withColumns(post)
    return out


def cluster_by_entity(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition a panel by its entity keys so that the following
    per-entity aggregates and windows reuse one exchange."""
    return panel.repartition(*[F.col(k) for k in keys]) if keys else panel


def with_year(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    return panel.withColumn("year", F.year(spec.period).cast("bigint"))


def annual_metrics(panel: DataFrame, keys: Sequence[str], spec: PanelSpec = DEFAULT,
                   periods_per_year: int = 4) -> DataFrame:
    """Complete years only (``count(*) = 4``): flows summed, the stock averaged
    over the four period ends, the published rate averaged, and the rate
    recomputed as 100 * sum(loss) / avg(balance). A measure missing in any
    period of the year is NULL for that year (incomplete for that measure)."""
    n = F.count(F.lit(1))
    full = lambda c: F.count(c) == periods_per_year
    w = F.sum(spec.loss).cast("double")
    r = F.sum(spec.balance).cast("double") / n
    return (with_year(panel, spec)
            .groupBy(*keys, "year")
            .agg(n.alias("quarters"),
                 F.when(full(spec.loss), w).alias("write_offs"),
                 F.when(full(spec.balance), r).alias("avg_rollover"),
                 F.when(full(spec.billings), F.sum(spec.billings).cast("double")).alias("billings"),
                 F.when(full(spec.rate), F.sum(spec.rate).cast("double") / n)
                  .alias("rate_pct_avg_quarterly"),
                 F.when(full(spec.loss) & full(spec.balance),
                        F.try_divide(F.lit(100.0) * w, r)).alias("rate_pct_recomputed"))
            .where(F.col("quarters") == periods_per_year))


def annual_book(panel: DataFrame, keys: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per complete year: average counts, average balance and billings, summed
    loss, and the year-end (fourth-quarter) value of both counts and the balance.
    A measure that lacks a quarter is NULL."""
    is_q4 = F.month(spec.period) == 10
    avg = lambda c: full_avg(c, 4)
    ye = lambda c: F.max(F.when(is_q4, F.col(c))).cast("double")
    return (with_year(panel, spec)
            .groupBy(*keys, "year")
            .agg(F.count(F.lit(1)).alias("quarters"),
                 avg(spec.principal).alias("p"), avg(spec.supplementary).alias("s"),
                 avg(spec.balance).alias("r"), avg(spec.billings).alias("b"),
                 full_sum(spec.loss, 4).alias("w"),
                 ye(spec.principal).alias("pe"), ye(spec.supplementary).alias("se"),
                 ye(spec.balance).alias("re"))
            .where(F.col("quarters") == 4))


def window_stats(panel: DataFrame, windows: DataFrame, keys: Sequence[str],
                 spec: PanelSpec = DEFAULT, window_keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Aggregate arbitrary period sets. ``windows`` maps ``(keys, window_id,
    period, expected)``; every window has a row with the loss, the average
    balance, their ratio, the rate annualised to a year (ratio*100*4/expected),
    the average published rate, the number of periods found and ``complete``
    (all requested periods found). A statistic of a measure that lacks a
    requested period is NULL."""
    missing = [k for k in keys if k not in windows.columns]
    if missing:
        raise ValueError(f"windows lack the keys {missing}")
    found = panel.select(*keys, spec.period, spec.loss, spec.balance, spec.rate, F.lit(True).alias("_found"))
    joined = windows.join(found, [*keys, spec.period], "left")
    n = F.max("expected")

    def total(c):
        return F.when(F.count(c) == n, F.sum(c).cast("double"))

    here = F.when(F.col("_found"), F.col(spec.period))
    stats = (joined.groupBy(*keys, *window_keys)
             .agg(total(spec.loss).alias("loss"), (total(spec.balance) / n).alias("avg_balance"),
                  (total(spec.rate) / n).alias("rate_pub"),
                  F.count("_found").alias("nq"), n.alias("expected"),
                  F.min(here).alias("first_period"), F.max(here).alias("last_period")))
    return (stats.withColumn("ratio", ratio("loss", "avg_balance"))
            .withColumn("rate_pct", F.col("ratio") * 100 * 4 / F.col("expected"))
            .withColumn("complete", F.col("nq") == F.col("expected")))


def year_windows(years: DataFrame, keys: Sequence[str] = (), period: str = "period") -> DataFrame:
    """(keys, year) -> (keys, window_id=year, period, expected=4): the four
    quarter starts of each year."""
    from ..functions.periods import year_quarter_starts
    return (years.select(*keys, F.col("year").alias("window_id"),
                         F.explode(year_quarter_starts(F.col("year").cast("int"))).alias(period))
            .withColumn("expected", F.lit(4)))
