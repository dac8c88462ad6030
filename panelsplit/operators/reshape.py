"""Wide series tables <-> tidy panels, with cell accounting.

A wide table has id columns (entity keys + ``series``) and one STRING column per
period label ``YYYYqQ``. Staging = unpivot (NULL cells dropped) -> label and
value filters -> parse -> pivot back with an explicit series list (no extra
job to discover pivot values). Every step is a narrow projection except the
final pivot aggregate on ``(keys, period)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import plain_text
from ..functions.periods import is_quarter_label, period_from_label, wide_label

# A value string Spark would cast but a strict numeric reader would not
# (Java accepts a trailing d/D/f/F type suffix).
_TYPE_SUFFIX = r"[0-9.][dDfF]\s*$"


def period_columns(wide: DataFrame, ids: Sequence[str]) -> list[str]:
    """All columns except the id columns (``COLUMNS(* EXCLUDE ids)``)."""
    return [c for c in wide.columns if c not in set(ids)]


def unpivot_periods(wide: DataFrame, ids: Sequence[str], keep_nulls: bool = False) -> DataFrame:
    """(ids..., label, value STRING); NULL cells dropped unless ``keep_nulls``.

    Written as ``inline(array(struct(label, value), ...))`` rather than
    ``DataFrame.unpivot``: both are one narrow generator step, but the
    ``Expand`` behind ``unpivot`` trips a whole-stage codegen compile error
    (Spark 4.1) when the cell tests downstream share subexpressions, and the
    stage then falls back to interpreted execution."""
    cols = period_columns(wide, ids)
    cells = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").cast("string").alias("value"))
                      for c in cols])
    long = wide.select(*ids, F.inline(cells))
    return long if keep_nulls else long.where(F.col("value").isNotNull())


def numeric_value(value) -> Column:
    """try_cast to DOUBLE, rejecting type-suffixed literals ('1.0d', '5f').
    NaN/Infinity stay castable so the finite check can see them."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.trim(v).rlike(_TYPE_SUFFIX), F.trim(v).try_cast("double"))


def exclusion_rules(series_col: str, series: Sequence[str]) -> dict[str, Column]:
    """Named exclusion rules; a cell may match several."""
    return {
        "period label unparseable": ~is_quarter_label("label"),
        "value not numeric": numeric_value("value").isNull(),
        "unexpected series": ~F.col(series_col).isin(list(series)),
    }


def stage_wide(wide: DataFrame, keys: Sequence[str], mapping: dict[str, str],
               series_col: str = "series", period: str = "period") -> DataFrame:
    """Wide -> tidy panel (keys, period, one DOUBLE column per mapped series).
    ``mapping``: series name in the file -> panel column name."""
    return _staged(unpivot_periods(wide, [*keys, series_col]), keys, mapping, series_col, period)


def _staged(long: DataFrame, keys: Sequence[str], mapping: dict[str, str], series_col: str, period: str) -> DataFrame:
    """(keys, series, label, value) cells -> tidy panel, without the cells that an exclusion rule matches."""
    rules = exclusion_rules(series_col, list(mapping))
    keep = ~reduce(lambda a, b: a | b, rules.values())
    parsed = long.where(keep).select(*keys, F.col(series_col), period_from_label("label").alias(period),
                                     numeric_value("value").alias("v"))
    out = parsed.groupBy(*keys, period).pivot(series_col, list(mapping)).agg(F.max("v"))
    return out.select(*keys, period, *[F.col(f"`{s}`").alias(c) for s, c in mapping.items()])


def cell_accounting(wide: DataFrame, staged: DataFrame, keys: Sequence[str], mapping: dict[str, str],
                    series_col: str = "series") -> DataFrame:
    """Per entity: raw cells (physical grid), missing (NULL/blank), present,
    per-rule and any-rule exclusions, staged cells, and whether
    staged + excluded + missing == raw. One aggregate per side."""
    ids = [*keys, series_col]
    long = unpivot_periods(wide, ids, keep_nulls=True)
    # whole-table accounting (no keys) joins the two one-row sides on a constant
    gk = list(keys) or ["_all"]
    if not keys:
        long, staged = long.withColumn("_all", F.lit(1)), staged.withColumn("_all", F.lit(1))
    rules = exclusion_rules(series_col, list(mapping))
    missing = F.col("value").isNull() | (F.trim("value") == "")
    any_rule = reduce(lambda a, b: a | b, rules.values())
    rule_aggs = [F.count_if(~missing & r).alias(f"rule_{i + 1}") for i, r in enumerate(rules.values())]
    raw = long.groupBy(*gk).agg(
        F.count(F.lit(1)).alias("raw_cells"), F.count_if(missing).alias("missing_cells"),
        F.count_if(~missing).alias("present_cells"), F.count_if(~missing & any_rule).alias("excluded_cells"),
        *rule_aggs)
    cols = list(mapping.values())
    staged_n = staged.groupBy(*gk).agg(
        reduce(lambda a, b: a + b, [F.count(c) for c in cols]).alias("staged_cells"),
        F.count(F.lit(1)).alias("staged_periods"))
    out = raw.join(staged_n, gk, "left").fillna(0, ["staged_cells", "staged_periods"])
    if not keys:
        out = out.drop("_all")
    return out.withColumn("reconciles", F.col("staged_cells") + F.col("excluded_cells") + F.col("missing_cells")
                          == F.col("raw_cells"))


def panel_to_long(panel: DataFrame, keys: Sequence[str], series: dict[str, str],
                  period: str = "period") -> DataFrame:
    """(keys, series, label, value STRING) from a panel; ``series``: series
    name -> panel column. Numbers are written as plain decimal text."""
    return _cells(panel, keys, series, period)


def _cells(panel: DataFrame, keys: Sequence[str], series: dict[str, str], period: str, keep_nulls: bool = True) -> DataFrame:
    """One row per cell, as in ``unpivot_periods``. Values are written plain once the cells are rows: once per column,
    the generated code would be too long to compile, and the stage would run interpreted."""
    cells = F.array(*[F.struct(F.lit(s).alias("series"), F.col(c).cast("string").alias("value")) for s, c in series.items()])
    long = panel.select(*keys, wide_label(period).alias("label"), F.inline(cells))
    return (long if keep_nulls else long.where(F.col("value").isNotNull())).withColumn("value", plain_text("value"))


def pivot_wide(long: DataFrame, keys: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """(keys, series, label, value) -> one row per (keys, series), one column
    per label (newest first when ``labels`` is given in that order)."""
    g = long.groupBy(*keys, "series")
    return (g.pivot("label", list(labels)) if labels is not None else g.pivot("label")).agg(F.first("value"))


# ------------------------------------------------------------------ wide rows as maps

def panel_to_maps(panel: DataFrame, keys: Sequence[str], series: dict[str, str], period: str = "period") -> DataFrame:
    """(keys, series, cells): one wide row per entity and series, its cells a map from label to value text.

    The labels are data, so nothing has to find them out before the job is planned, and entities may have different
    ones. A series is as long as its periods; entity-clustered panels need no exchange. A period that an entity has
    twice has no place in a wide row and fails the job (the period check reports it)."""
    long = _cells(panel, keys, series, period, keep_nulls=False)
    return long.groupBy(*keys, "series").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("cells"))


def stage_maps(maps: DataFrame, keys: Sequence[str], mapping: dict[str, str], series_col: str = "series",
               period: str = "period") -> DataFrame:
    """Wide rows as maps -> tidy panel, by the rules of ``stage_wide``."""
    long = maps.select(*keys, series_col, F.explode("cells").alias("label", "value"))
    return _staged(long, keys, mapping, series_col, period)


def map_accounting(maps: DataFrame, staged: DataFrame, keys: Sequence[str], mapping: dict[str, str],
                   series_col: str = "series") -> DataFrame:
    """``cell_accounting`` for wide rows as maps: an entity's grid has the labels that any of its series has."""
    rules = exclusion_rules(series_col, list(mapping))
    cells = maps.select(*keys, series_col, F.explode("cells").alias("label", "value"))
    blank = F.trim("value") == ""
    any_rule = reduce(lambda a, b: a | b, rules.values())
    by_label = cells.groupBy(*keys, "label").agg(
        F.count_if(~blank).alias("present"), F.count_if(~blank & any_rule).alias("excluded"),
        *[F.count_if(~blank & r).alias(f"r{i + 1}") for i, r in enumerate(rules.values())])
    per = by_label.groupBy(*keys).agg(F.count(F.lit(1)).alias("labels"), F.sum("present").alias("present_cells"), F.sum("excluded").alias("excluded_cells"),
                                      *[F.sum(f"r{i + 1}").alias(f"rule_{i + 1}") for i in range(len(rules))])
    series = maps.groupBy(*keys).agg(F.count(F.lit(1)).alias("series_rows"))
    cols = list(mapping.values())
    kept = staged.groupBy(*keys).agg(reduce(lambda a, b: a + b, [F.count(c) for c in cols]).alias("staged_cells"), F.count(F.lit(1)).alias("staged_periods"))
    out = (per.join(series, list(keys)).join(kept, list(keys), "left").fillna(0, ["staged_cells", "staged_periods"])
           .withColumn("raw_cells", F.col("labels") * F.col("series_rows")))
    out = out.withColumn("missing_cells", F.col("raw_cells") - F.col("present_cells"))
    return out.select(*keys, "labels", "raw_cells", "missing_cells", "present_cells", "excluded_cells", *[f"rule_{i + 1}" for i in range(len(rules))],
                      "staged_cells", "staged_periods",
                      (F.col("staged_cells") + F.col("excluded_cells") + F.col("missing_cells") == F.col("raw_cells")).alias("reconciles"))
