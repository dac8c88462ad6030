"""Chart data from a bridge (the numbers behind waterfall and stacked bars).

All are ``stack`` (unpivot to a few rows per bridge row) plus running sums
over a window partitioned by (keys, year): bounded by 4 rows per window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contributions(bridge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, year, part, part_order, value): the two signed parts per year."""
    return bridge.select(*keys, "year",
                         F.expr("stack(2, 'volume', 1, volume, 'rate', 2, rate) AS (part, part_order, value)"))


def waterfall(bridge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """start -> +volume -> +rate -> end with the running total and each
    bar's base and top (base = min(before, after))."""
    steps = bridge.select(
        *keys, "year",
        F.expr("stack(4, 'start', 1, write_offs - delta_write_offs, "
               "'volume', 2, volume, 'rate', 3, rate, 'end', 4, write_offs) AS (step, step_order, value)"))
    w = Window.partitionBy(*keys, "year").orderBy("step_order").rowsBetween(Window.unboundedPreceding, 0)
    moving = F.col("step").isin("volume", "rate")
    running = F.sum(F.when(F.col("step") != "end", F.col("value")).otherwise(F.lit(0.0))).over(w)
    steps = steps.withColumn("running", F.when(F.col("step") == "end", F.col("value")).otherwise(running))
    before = F.col("running") - F.col("value")
    return steps.withColumns({
        "bar_base": F.when(moving, F.least(before, F.col("running"))).otherwise(F.lit(0.0)),
        "bar_top": F.when(moving, F.greatest(before, F.col("running"))).otherwise(F.col("value")),
    })


def signed_stack(bridge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positive parts stacked upward from 0, negative parts downward, each in
    part order: (keys, year, part, value, bar_base, bar_top)."""
    parts = contributions(bridge, keys)
    w = Window.partitionBy(*keys, "year").orderBy("part_order").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.col("value") >= 0
    below_pos = F.coalesce(F.sum(F.when(F.col("value") >= 0, F.col("value"))).over(w), F.lit(0.0))
    below_neg = F.coalesce(F.sum(F.when(F.col("value") < 0, F.col("value"))).over(w), F.lit(0.0))
    base = F.when(pos, below_pos).otherwise(below_neg)
    return parts.withColumn("bar_base", base).withColumn("bar_top", F.col("bar_base") + F.col("value"))
