"""Period expressions: quarter starts, quarter index, labels.

All of these are built-in column expressions (codegen'd, no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wide files' label formats.
QUARTER_LABEL_PATTERN = r"^[0-9]{4}[1-4]Q\z"   # '20262Q' = 2026 Q2; \z so a trailing newline fails
YEAR_LABEL_PATTERN = r"^[0-9]{4}\z"
NUMERIC_TEXT_PATTERN = r"^-?[0-9]+(\.[0-9]+)?\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def quarter_start(ts) -> Column:
    """First day of the quarter of a date/timestamp column, as DATE."""
    return F.trunc(F.to_date(_c(ts)), "quarter")


def quarter_index(period) -> Column:
    """year*4 + quarter: consecutive quarters differ by exactly 1."""
    p = _c(period)
    return F.year(p) * 4 + F.quarter(p)


def period_label(period) -> Column:
    """'YYYY Qn' display label of a quarter-start date."""
    p = _c(period)
    return F.concat(F.year(p).cast("string"), F.lit(" Q"), F.quarter(p).cast("string"))


def label_of_index(index) -> Column:
    """Quarter index (year*4 + quarter) back to the 'YYYY Qn' display label."""
    i = _c(index).cast("bigint") - 1
    return F.concat(F.floor(i / 4).cast("string"), F.lit(" Q"), (F.pmod(i, F.lit(4)) + 1).cast("string"))


def wide_label(period) -> Column:
    """Quarter-start date to the wide-file column label 'YYYYqQ'."""
    p = _c(period)
    return F.concat(F.year(p).cast("string"), F.quarter(p).cast("string"), F.lit("Q"))


def is_quarter_label(label) -> Column:
    return _c(label).rlike(QUARTER_LABEL_PATTERN)


def period_from_label(label) -> Column:
    """'YYYYqQ' -> quarter-start DATE. NULL for labels that do not match, so
    ANSI casts never see a malformed label."""
    lab = _c(label)
    y = F.substring(lab, 1, 4).cast("int")
    q = F.substring(lab, 5, 1).cast("int")
    return F.when(is_quarter_label(lab), F.make_date(y, (q - 1) * 3 + 1, F.lit(1)))


def year_quarter_starts(year) -> Column:
    """ARRAY<DATE> of the four quarter starts of a year (explode to rows)."""
    y = _c(year)
    return F.sequence(F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(10), F.lit(1)),
                      F.expr("INTERVAL 3 MONTHS"))


def month_span_label(first, last) -> Column:
    """'YYYY-MM → YYYY-MM' label of a window of periods."""
    return F.concat(F.date_format(_c(first), "yyyy-MM"), F.lit(" → "),
                    F.date_format(_c(last), "yyyy-MM"))
