"""Invariance properties on the driver tables (small scale factor):
key-partition invariance, row-order/partitioning invariance, hot-key
correctness, and map-side partial aggregation in the panel plan."""

import contextlib
import io

from pyspark.sql import functions as F

from panelsplit.functions.periods import quarter_start
from panelsplit.operators import decompose as D
from panelsplit.operators.panel import build_panel
from panelsplit.operators.profile import table_hash
from panelsplit.plans import facts as FX
from tests.conftest import SF_SMALL

SEG = ["c_mktsegment"]


def test_key_partition_invariance(spark):
    """A bridge computed on all entities equals the union of bridges computed
    entity by entity (no cross-entity leakage through windows or joins)."""
    panel = FX.fact_panel(spark, SF_SMALL, SEG)
    whole = D.yearly_bridge(panel, SEG).drop("closes")
    segments = [r[0] for r in panel.select(*SEG).distinct().collect()]
    parts = None
    for s in segments:
        b = D.yearly_bridge(panel.where(F.col(SEG[0]) == s), SEG).drop("closes")
        parts = b if parts is None else parts.unionByName(b)
    assert table_hash(whole).collect() == table_hash(parts).collect()


def test_row_order_invariance(spark):
    """Reordering and repartitioning the facts does not change a single bit
    of the panel (decimal sums are exact)."""
    facts = FX.order_facts(spark, SF_SMALL, SEG)
    aggs = FX.fact_measures()
    a = build_panel(facts, SEG, quarter_start("o_orderdate"), aggs)
    shuffled = facts.repartition(7).orderBy(F.rand(42))
    b = build_panel(shuffled, SEG, quarter_start("o_orderdate"), aggs)
    assert table_hash(a).collect() == table_hash(b).collect()


def test_order_level_equals_line_level(spark):
    line = FX.fact_panel(spark, SF_SMALL, SEG).drop("supplementary")
    order = FX.fact_panel(spark, SF_SMALL, SEG, line_level=False)
    assert table_hash(line).collect() == table_hash(order.select(*line.columns)).collect()


def test_hot_key_panel(spark):
    """One entity holding a third of the rows aggregates correctly, and the
    plan combines map-side (partial aggregate before the exchange)."""
    facts = FX.order_facts(spark, SF_SMALL, []).withColumn(
        "hot", F.when(F.col("l_orderkey") % 3 == 0, F.lit("HOT")).otherwise(F.col("l_suppkey").cast("string")))
    panel = build_panel(facts, ["hot"], quarter_start("o_orderdate"), {"lines": F.count(F.lit(1))})
    got = panel.where(F.col("hot") == "HOT").agg(F.sum("lines")).collect()[0][0]
    assert got == facts.where(F.col("hot") == "HOT").count()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        panel.explain()
    plan = buf.getvalue()
    assert "partial_count" in plan and plan.index("partial_count") > plan.index("Exchange")


def test_hash_runs_read_the_facts_once_each(spark, monkeypatch):
    """The hashes of the registered tables, from two panels: one per execution."""
    from panelsplit.plans.queries import QUERIES

    build, calls = FX.fact_panel, []
    monkeypatch.setattr(FX, "fact_panel", lambda *a, **k: calls.append(a) or build(*a, **k))
    got = {r["table"]: r for r in QUERIES["table_hash"](spark, SF_SMALL).collect()}
    assert len(calls) == 2 and all(r["reproducible"] for r in got.values())
    for name in ("panel_quarterly", "bridge_yearly", "sensitivity"):
        want = table_hash(QUERIES[name](spark, SF_SMALL)).collect()[0]
        assert (got[name]["rows"], got[name]["content_hash"]) == (want["rows"], want["content_hash"])
