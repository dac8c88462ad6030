"""Incremental panel refresh: landed files in micro-batches; the panel equals
the batch aggregate, after a replay as well."""

import os

import pytest
from pyspark.sql import functions as F

from panelsplit.streaming.panel_stream import append_changes, current_panel, incremental_panel, refresh_to_table
from tests.conftest import SF_SMALL


def test_two_batches_upsert(spark, tmp_path):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey", "l_extendedprice", "l_returnflag")
    src = str(tmp_path / "src")
    li.where(F.col("l_orderkey") % 2 == 0).coalesce(1).write.parquet(f"{src}/a")
    li.where(F.col("l_orderkey") % 2 == 1).coalesce(1).write.parquet(f"{src}/b")
    schema = li.schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(src))
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_orderdate")
    facts = stream.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    measures = {"billings": ("sum", F.col("l_extendedprice").cast("decimal(18,2)")), "lines": ("count", F.lit(1))}
    sdf = incremental_panel(facts, ["l_returnflag"], F.trunc(F.to_date("o_orderdate"), "quarter"), measures)
    table = str(tmp_path / "panel")
    out = refresh_to_table(sdf, table, str(tmp_path / "ckpt"), ["l_returnflag", "period"])
    assert sorted(os.listdir(table)) == ["batch=0", "batch=1"]
    batch = (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .groupBy("l_returnflag", F.trunc(F.to_date("o_orderdate"), "quarter").alias("period"))
             .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("billings"),
                  F.count(F.lit(1)).alias("lines")))
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0
    # A batch that runs again replaces its own cells only.
    last = spark.createDataFrame(spark.read.parquet(f"{table}/batch=1").collect(), out.select("l_returnflag", "period", "billings", "lines").schema)
    append_changes(table)(last, 1)
    again = current_panel(spark, table, ["l_returnflag", "period"])
    assert again.exceptAll(batch).count() == 0 and batch.exceptAll(again).count() == 0
    # What arrives later joins the state that was kept.
    li.limit(50).coalesce(1).write.parquet(f"{src}/c")
    more = refresh_to_table(sdf, table, str(tmp_path / "ckpt"), ["l_returnflag", "period"])
    assert more.agg(F.sum("lines")).collect()[0][0] == li.count() + 50


def test_distinct_measure_refused(spark):
    df = spark.range(3).withColumn("d", F.current_date())
    with pytest.raises(ValueError):
        incremental_panel(df, [], F.col("d"), {"n": ("count_distinct", F.col("id"))})
