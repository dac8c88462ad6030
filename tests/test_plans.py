"""Physical-plan properties: no Python in any plan, one scan per table for the
fused checks, per-entity windows are not collapsed to a single partition, and
column pruning reaches the scans."""

import contextlib
import io
import re

import pytest

from panelsplit.plans.queries import QUERIES
from tests.conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


CHEAP = [n for n in QUERIES if n not in ("table_hash", "landing_checks", "gated_write")]


@pytest.mark.parametrize("name", CHEAP)
def test_no_python_udf(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert not re.search(r"PythonUDF|EvalPython|InPandas|InArrow|Python", p)


def test_checks_scan_each_table_once(spark):
    p = plan(QUERIES["quality_checks"](spark, SF_SMALL))
    assert p.count("lineitem.parquet") == 1 and p.count("orders.parquet") == 1


def test_entity_windows_are_partitioned(spark):
    for name in ("bridge_yearly", "trailing4_full", "sensitivity", "book_split"):
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "SinglePartition" not in p, name


def test_column_pruning(spark):
    for name in ("annual_metrics", "bridge_base_weighted", "book_split"):
        p = plan(QUERIES[name](spark, SF_SMALL))
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
        assert schemas and all("l_comment" not in s and "l_tax" not in s and "l_quantity" not in s
                               for s in schemas), name


def test_one_pass_over_the_facts(spark):
    """Queries that read the panel and the published table from two branches
    checkpoint the panel once: the returned plan scans no fact table again."""
    for name in ("bridge_yearly", "published_basis"):
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "lineitem.parquet" not in p and "orders.parquet" not in p, name


def test_reconciliations_read_each_source_once(spark):
    """The panel and the published table come from passes of their own; the damaged twins add none."""
    for name in ("rate_reconcile", "flow_stock_reconcile"):
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert p.count("Location: InMemoryFileIndex") == p.count("lineitem.parquet]") + p.count("orders.parquet]") + p.count("customer.parquet]")
        assert p.count("lineitem.parquet]") == 2 and p.count("orders.parquet]") == 2, name
