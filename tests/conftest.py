import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelsplit.session import local_session
    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


def quarter_panel(spark, rows, keys=("k",)):
    """Literal panel: rows of (key..., 'YYYY-MM-DD', principal, supplementary,
    billings, rollover, write_offs, rate_pct) with DOUBLE measures."""
    from pyspark.sql import functions as F
    cols = [*keys, "p", "principal", "supplementary", "billings", "rollover", "write_offs", "rate_pct"]
    schema = ", ".join([f"{k} string" for k in keys] + ["p string"] +
                       [f"{c} double" for c in cols[len(keys) + 1:]])
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("period", F.to_date("p")).drop("p")
