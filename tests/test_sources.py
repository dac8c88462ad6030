"""Table scans and text forms."""

from decimal import Decimal

from panelsplit.functions.numeric import plain_text
from panelsplit.sources.tables import read_table
from tests.conftest import SF_SMALL


def test_scan_reads_only_what_is_used(spark):
    li = read_table(spark, SF_SMALL, "lineitem").select("l_orderkey")
    assert "ReadSchema: struct<l_orderkey:bigint>" in li._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_numbers_are_written_exactly(spark):
    values = [1.23456789012345, 1.23e-12, 98.0, 0.5, 1e20, -2.5e-7, 0.0, 123456789.33, -98765432.0, 1.25e-40, 1.5e300]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(plain_text("v")).collect()]
    assert got == ["1.23456789012345", "0.00000000000123", "98", "0.5", "100000000000000000000", "-0.00000025", "0", "123456789.33", "-98765432",
                   "0." + "0" * 39 + "125", "15" + "0" * 299]
    assert spark.createDataFrame([(Decimal("22716202.070"),)], "v decimal(20,3)").select(plain_text("v")).collect()[0][0] == "22716202.07"
