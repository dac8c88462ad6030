"""Audit findings: one long table ``(segment, finding, subject, value)``
assembled from the check, profile, reconciliation, seasonal, move and decline
queries (each entity's findings side by side for review)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.periods import period_label
from ..operators import checks as K
from ..operators import metrics as M
from ..operators import reconcile as RC
from . import facts as FX
from .q_checks import AS_OF, FLOOR, MIN_PERIODS
from .q_checks import _MEASURES as MEASURES
from .registry import ORACLE, SEG, register

_K = "c_mktsegment"


def _label_sql(col: str) -> str:
    return f"CAST(year({col}) AS VARCHAR) || ' Q' || CAST(quarter({col}) AS VARCHAR)"


def _audit_sql() -> str:
    parts = [
        f"SELECT {_K}, 'check: ' || check_name AS finding, '' AS subject, CAST(violations AS DOUBLE) AS value "
        f"FROM ({ORACLE['quality_checks_segment']}) AS t",
        f"SELECT {_K}, 'series min', series, min_value FROM ({ORACLE['series_profile']}) AS t",
        f"SELECT {_K}, 'series max', series, max_value FROM ({ORACLE['series_profile']}) AS t",
        f"SELECT {_K}, 'max flow gap', 'annual', max_flow_gap FROM ({ORACLE['flow_stock_reconcile']}) AS t WHERE {_K} NOT LIKE 'damaged:%'",
        f"SELECT {_K}, 'max stock gap', 'year end', max_stock_gap FROM ({ORACLE['flow_stock_reconcile']}) AS t WHERE {_K} NOT LIKE 'damaged:%'",
        f"SELECT {_K}, 'seasonal mean rate_pct', 'Q' || CAST(quarter_of_year AS VARCHAR), mean_rate_pct "
        f"FROM ({ORACLE['seasonal_means']}) AS t",
        f"SELECT {_K}, 'largest principal move %', {_label_sql('from_period')} || ' → ' || "
        f"{_label_sql('to_period')}, change_pct FROM ({ORACLE['largest_move']}) AS t",
        f"SELECT {_K}, 'declining years', 'supplementary', CAST(declining_years AS DOUBLE) "
        f"FROM ({ORACLE['decline_count']}) AS t",
    ]
    return " UNION ALL ".join(parts)


@register("audit_findings", sql=_audit_sql())
def audit_findings(spark, sf_dir):
    """One checkpointed panel feeds all six finding groups (the panel is
    computed once; each group is a small aggregate over it)."""
    panel = FX.fact_panel(spark, sf_dir, SEG, materialize=True)
    pub = FX.published_annual(panel, SEG)
    q = {
        "checks": K.quality_checks(panel, SEG, floor=FLOOR, as_of=AS_OF, min_periods=MIN_PERIODS),
        "profile": M.series_profile(panel, SEG, MEASURES),
        "reconcile": RC.flow_stock_reconcile(panel, pub, SEG),
        "seasonal": M.seasonal_means(panel, SEG, "rate_pct"),
        "move": M.largest_move(panel, SEG, "principal"),
        "decline": M.decline_count(panel, SEG, "supplementary"),
    }
    row = lambda df, finding, subject, value: df.select(
        _K, F.lit(finding) if isinstance(finding, str) else finding,
        F.lit(subject) if isinstance(subject, str) else subject, value.cast("double"))
    parts = [
        row(q["checks"], F.concat(F.lit("check: "), F.col("check_name")), "", F.col("violations")),
        row(q["profile"], "series min", F.col("series"), F.col("min_value")),
        row(q["profile"], "series max", F.col("series"), F.col("max_value")),
        row(q["reconcile"], "max flow gap", "annual", F.col("max_flow_gap")),
        row(q["reconcile"], "max stock gap", "year end", F.col("max_stock_gap")),
        row(q["seasonal"], "seasonal mean rate_pct",
            F.concat(F.lit("Q"), F.col("quarter_of_year").cast("string")), F.col("mean_rate_pct")),
        row(q["move"], "largest principal move %",
            F.concat(period_label("from_period"), F.lit(" → "), period_label("to_period")), F.col("change_pct")),
        row(q["decline"], "declining years", "supplementary", F.col("declining_years")),
    ]
    out = parts[0].toDF(_K, "finding", "subject", "value")
    for p in parts[1:]:
        out = out.unionAll(p.toDF(_K, "finding", "subject", "value"))
    return out
