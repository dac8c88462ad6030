"""Numeric column expressions used by the decomposition and the checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_finite(col) -> Column:
    """True for finite numbers. NaN fails (NaN sorts above +Infinity in Spark),
    +/-Infinity fail; NULL stays NULL."""
    c = _c(col).cast("double")
    return F.abs(c) < F.lit(float("inf"))


def snap_zero(value, *scale) -> Column:
    """Set |value| <= 1e-12 * max(1, |scale...|) to exactly 0.0: what rounding leaves of a
    sum that is zero carries no sign."""
    v = _c(value)
    bound = F.greatest(F.lit(1.0), *[F.abs(_c(s)) for s in scale]) if scale else F.lit(1.0)
    return F.when(F.abs(v) <= F.lit(1e-12) * bound, F.lit(0.0)).otherwise(v)


def unsigned_zero(value) -> Column:
    """-0.0 -> +0.0 (x + 0.0 maps -0.0 to +0.0 and leaves every other value)."""
    return _c(value) + F.lit(0.0)


def ratio(num, den) -> Column:
    """num / den as double; NULL when den is 0 or NULL (no ANSI error)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct_change(new, old) -> Column:
    """(new / old - 1) * 100."""
    return (ratio(new, old) - F.lit(1.0)) * F.lit(100.0)


def any_null(*cols) -> Column:
    return reduce(lambda a, b: a | b, [_c(c).isNull() for c in cols])


def full_sum(col, n: int) -> Column:
    """Sum over exactly ``n`` non-null values as double; NULL when one is missing."""
    return F.when(F.count(_c(col)) == F.lit(n), F.sum(_c(col)).cast("double"))


def full_avg(col, n: int) -> Column:
    """Average over exactly ``n`` non-null values; NULL when one is missing."""
    return full_sum(col, n) / F.lit(n)


def money(col, precision: int = 18, scale: int = 2) -> Column:
    """Cast a money input to DECIMAL before summing: sums become exact and
    independent of row order (bit-equal results across engines)."""
    return _c(col).cast(f"decimal({precision},{scale})")


def plain_text(col) -> Column:
    """Number -> its exact decimal text without exponent or trailing zeros
    (integers as '98', money as '22716202.07'). A double is written as its
    shortest exact representation."""
    s = _c(col).cast("string")
    # From mantissa and exponent, when there is one: the digits with the zeros that place the point, then the point.
    exponent = F.substring_index(s, "E", -1).try_cast("int")
    digits = F.translate(F.substring_index(s, "E", 1), "-.", "")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(-exponent, F.lit(0))), digits, F.repeat(F.lit("0"), F.greatest(exponent - F.length(digits) + 1, F.lit(0))))
    place = F.greatest(exponent, F.lit(0)) + 1
    plain = F.concat(F.when(s.startswith("-"), "-").otherwise(""), F.substr(padded, F.lit(1), place), F.lit("."), F.substr(padded, place + 1))
    s = F.when(s.contains("E") & s.rlike(r"^-?[0-9]\.?[0-9]*E-?[0-9]+$"), plain).otherwise(s)
    return F.when(s.contains("."), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)
