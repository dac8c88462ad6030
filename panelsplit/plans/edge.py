"""Query-edge normalisation shared by the driver queries and their SQL oracles.

The library never rounds; the edge of a registered query rounds doubles to a
fixed number of digits (both in Spark and in the oracle SQL) so that results
computed in the same order by two engines compare equal, and maps -0.0 to 0.0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, DoubleType, FloatType, IntegerType, ShortType

DIGITS = 6


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round double columns, widen small ints to BIGINT, unsign zeros."""
    repl = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType, DecimalType)):
            repl[f.name] = F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (IntegerType, ShortType, ByteType)):
            repl[f.name] = F.col(f.name).cast("bigint")
    return df.withColumns(repl) if repl else df


def sql_finish(sql: str, keep: Sequence[str] = (), digits: int = DIGITS) -> str:
    """DuckDB twin of ``finish``: round every column except ``keep`` (the
    non-double ones) to ``digits``."""
    if keep:
        cols = ", ".join(keep)
        return (f"SELECT {cols}, round(COLUMNS(* EXCLUDE ({cols}))::DOUBLE, {digits}) + 0.0 "
                f"FROM ({sql}) AS _q")
    return f"SELECT round(COLUMNS(*)::DOUBLE, {digits}) + 0.0 FROM ({sql}) AS _q"
