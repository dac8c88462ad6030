"""Incremental panel refresh with Structured Streaming.

New fact files land in a folder; a streaming query joins them to the static
dimension tables and aggregates the *additive* measures by ``(keys, period)``
(state store keyed by panel cell, so state is bounded by the panel, not by the
facts). Every micro-batch appends the cells that it changed, with its batch
number; the panel is each cell as its last batch left it, one aggregate over
the appended cells. A batch that is replayed writes its own folder again, so
nothing counts twice.

Distinct counts (principal / supplementary) are not additive across batches
and are therefore refused here; they stay in the batch panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ADDITIVE = {"sum": F.sum, "count": F.count}


def incremental_panel(facts: DataFrame, keys: Sequence[str], period: Column,
                      measures: dict[str, tuple[str, Column]], period_name: str = "period") -> DataFrame:
    """Streaming aggregate of additive measures per (keys, period).

    ``measures``: name -> (function, input column) with function 'sum' or
    'count'; anything else (distinct counts, averages, maxima) cannot be
    merged across batches by addition and is refused."""
    aggs = []
    for name, (fn, expr) in measures.items():
        if fn not in _ADDITIVE:
            raise ValueError(f"measure {name!r} uses {fn!r}; only sum and count can be refreshed incrementally")
        aggs.append(_ADDITIVE[fn](expr).alias(name))
    return facts.groupBy(*keys, period.alias(period_name)).agg(*aggs)


def append_changes(table: str):
    """foreachBatch function: the batch's cells, in a folder named by its number."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
    return write


def current_panel(spark: SparkSession, table: str, cell_keys: Sequence[str]) -> DataFrame:
    """Every cell as the last batch that changed it left it."""
    rows = spark.read.option("basePath", table).parquet(table)
    values = [c for c in rows.columns if c not in (*cell_keys, "batch")]
    latest = rows.groupBy(*cell_keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("v"))
    return latest.select(*cell_keys, *[F.col(f"v.{c}").alias(c) for c in values])


def refresh_to_table(sdf: DataFrame, table: str, checkpoint: str, cell_keys: Sequence[str]) -> DataFrame:
    """Run the streaming aggregate over everything available now; returns the panel as it is then."""
    q = (sdf.writeStream.outputMode("update")
         .foreachBatch(append_changes(table))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return current_panel(sdf.sparkSession, table, cell_keys)
