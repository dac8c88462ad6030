"""Registered queries vs their DuckDB oracle SQL (small scale factor), with
the same order-insensitive comparison as the driver's gate."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from check_oracle import _hash
from panelsplit.plans.queries import ORACLE, QUERIES
from panelsplit.sources.tables import TABLES, table_path
from tests.conftest import SF_SMALL

NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    left = pd.DataFrame([tuple(r) for r in sdf.collect()], columns=sdf.columns, dtype=object)
    rel = con.sql(E.oracle_sql()[name])
    right = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    assert sorted(left.columns) == sorted(right.columns)
    assert _hash(left) == _hash(right)


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only <= {"table_hash"}
    assert set(E.oracle_sql()) <= set(E.queries()) and set(QUERIES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "volume" in df.columns
