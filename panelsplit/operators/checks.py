"""Data-quality checks and the write gate.

The checks follow from the measures: every measure must be present and finite, a stock of things whole and
positive, money positive, a rate within bounds; and from the periods: none twice, none skipped, all within the
dates, enough of them. A check is named ``<measure>:<rule>`` or ``period:<rule>``. All are fused: one window pass
(``lag`` per entity) feeding one aggregate with a count per check, then ``stack`` to long rows
``(keys..., check_name, violations)``. One scan, one exchange (none when the panel is already clustered by entity).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_finite
from ..functions.periods import quarter_index
from ..spec import DEFAULT, RATE, PanelSpec
from .panel import entity_window

class GateError(RuntimeError):
    """Raised by ``gate`` when any check reports violations."""


def measure_rules(spec: PanelSpec = DEFAULT, highest_rate: float = 50) -> list[tuple[str, str, Column]]:
    """(measure, rule, condition of a violation) of every rule on a measure."""
    rules = []
    for m in spec.measures():
        c = F.col(m.name)
        rules += [(m.name, "missing", c.isNull()), (m.name, "not finite", ~is_finite(c))]
        if m.name in spec.counts():
            rules.append((m.name, "not whole", is_finite(c) & (c != F.round(c))))
        if m.name in spec.counts() + spec.money():
            rules.append((m.name, "not positive", c <= 0))
        if m.kind == RATE:
            rules.append((m.name, "out of bounds", is_finite(c) & ((c < 0) | (c > highest_rate))))
    return rules


def quality_checks(panel: DataFrame, keys: Sequence[str], spec: PanelSpec = DEFAULT,
                   floor: str | _dt.date = "2014-10-01", as_of: str | _dt.date | None = None,
                   min_periods: int = 40, highest_rate: float = 50) -> DataFrame:
    """Violations per entity and check (0 = pass)."""
    p = spec.period
    w = entity_window(keys).orderBy(p)
    latest = F.lit(str(as_of)).cast("date") if as_of is not None else F.current_date()
    before, before2 = F.lag(p, 1).over(w), F.lag(p, 2).over(w)
    flagged = panel.select(*keys, p, *spec.measure_names(),
                           ((F.col(p) == before) & (before2.isNull() | (before2 != F.col(p)))).alias("_again"),
                           (F.col(p) > F.add_months(before, 3)).alias("_skips"))
    checks = [(f"{measure}:{rule}", F.count_if(broken)) for measure, rule, broken in measure_rules(spec, highest_rate)]
    checks += [("period:repeated", F.count_if("_again")), ("period:skipped", F.count_if("_skips")),
               ("period:outside the dates", F.count_if((F.col(p) < F.lit(str(floor)).cast("date")) | (F.col(p) > latest))),
               ("period:too few", F.when(F.count(F.lit(1)) >= min_periods, 0).otherwise(1).cast("bigint"))]
    agg = flagged.groupBy(*keys).agg(*[c.alias(f"_c{i}") for i, (_, c) in enumerate(checks)])
    pairs = ", ".join(f"'{name}', _c{i}" for i, (name, _) in enumerate(checks))
    return agg.select(*keys, F.expr(f"stack({len(checks)}, {pairs}) AS (check_name, violations)"))


def gate(checks: DataFrame, what: str = "checks", report: str | None = None) -> None:
    """Stop before any write when a check failed.

    The error says how many entities and rows fail each check; ``report`` names a path to which all
    failing rows are written."""
    failed = checks.where(F.col("violations") > 0)
    totals = (failed.groupBy("check_name").agg(F.count(F.lit(1)).alias("entities"), F.sum("violations").alias("violations"))
              .orderBy("check_name").collect())
    if totals:
        if report:
            failed.write.mode("overwrite").parquet(report)
        raise GateError(f"{what} failed; nothing written. " + "; ".join(
            f"{r['check_name']}: {r['violations']} violations in {r['entities']} entities" for r in totals))


def closure_violations(bridge: DataFrame, keys: Sequence[str], flag: str = "closes") -> DataFrame:
    """(keys, check_name='bridge closes', violations) from a bridge's flag; a bridge that can't say (NULL) is a violation."""
    return bridge.groupBy(*keys).agg(
        F.lit("bridge closes").alias("check_name"), F.count_if(~F.coalesce(F.col(flag), F.lit(False))).alias("violations"))


def freshness(panel: DataFrame, keys: Sequence[str], as_of: str | _dt.date,
              spec: PanelSpec = DEFAULT, lag_quarters: int = 2) -> DataFrame:
    """Per entity: latest quarter index vs the floor (as_of quarter index -
    lag_quarters); ``fresh`` when latest >= floor."""
    floor = quarter_index(F.lit(str(as_of)).cast("date")) - lag_quarters
    return (panel.groupBy(*keys).agg(F.max(quarter_index(spec.period)).alias("latest_index"))
            .withColumn("floor_index", floor)
            .withColumn("fresh", F.col("latest_index") >= F.col("floor_index")))
