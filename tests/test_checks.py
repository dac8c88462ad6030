"""Mutation tests for the fused quality checks and the gate (nothing is
written when a check fails)."""

import os

import pytest

from panelsplit.operators.checks import GateError, closure_violations, gate, quality_checks
from tests.conftest import quarter_panel

QUARTERS = [f"{y}-{m:02d}-01" for y in (2020, 2021, 2022) for m in (1, 4, 7, 10)]


def clean_rows(key="a"):
    return [(key, q, 1000.0 + i, 500.0, 100.0 + i, 50.0 + i, 2.0 + i / 10, 5.0) for i, q in enumerate(QUARTERS)]


def run(spark, rows, **kw):
    p = quarter_panel(spark, rows)
    kw.setdefault("floor", "2020-01-01")
    kw.setdefault("as_of", "2023-06-30")
    kw.setdefault("min_periods", 12)
    out = quality_checks(p, ["k"], **kw).collect()
    return {r.check_name: r.violations for r in out if r.k == "a"}


def test_clean_panel_passes(spark):
    v = run(spark, clean_rows())
    assert {"principal:not whole", "rollover:missing", "billings:not positive", "rate_pct:out of bounds",
            "write_offs:not finite", "period:repeated", "period:skipped"} <= set(v) and len(v) == 24
    assert all(x == 0 for x in v.values()), v


def mutate(i, col, value):
    rows = clean_rows()
    cols = ["k", "p", "principal", "supplementary", "billings", "rollover", "write_offs", "rate_pct"]
    r = list(rows[i])
    r[cols.index(col)] = value
    rows[i] = tuple(r)
    return rows


@pytest.mark.parametrize("col,value,check", [
    ("principal", 100.5, "principal:not whole"),
    ("supplementary", -1.0, "supplementary:not positive"),
    ("rollover", None, "rollover:missing"),
    ("billings", 0.0, "billings:not positive"),
    ("rate_pct", 50.5, "rate_pct:out of bounds"),
    ("rate_pct", -0.1, "rate_pct:out of bounds"),
])
def test_single_mutations(spark, col, value, check):
    v = run(spark, mutate(3, col, value))
    assert v[check] == 1, v
    assert sum(v.values()) == 1, v


@pytest.mark.parametrize("col", ["principal", "supplementary", "billings", "rollover", "write_offs", "rate_pct"])
@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf")])
def test_non_finite(spark, col, value):
    v = run(spark, mutate(5, col, value))
    assert v[f"{col}:not finite"] == 1, v


def test_duplicate_and_gap(spark):
    rows = clean_rows()
    rows.append(rows[4])          # duplicate period
    del rows[8]                   # gap
    v = run(spark, rows, min_periods=1)
    assert v["period:repeated"] == 1
    assert v["period:skipped"] == 1


def test_range_and_coverage(spark):
    v = run(spark, clean_rows(), as_of="2021-12-31", min_periods=13)
    assert v["period:outside the dates"] == 4
    assert v["period:too few"] == 1


def test_gate_stops_before_write(spark, tmp_path):
    p = quarter_panel(spark, mutate(2, "principal", 100.5))
    target = str(tmp_path / "out")
    with pytest.raises(GateError):
        gate(quality_checks(p, ["k"], floor="2020-01-01", as_of="2023-06-30", min_periods=12))
        p.write.parquet(target)
    assert not os.path.exists(target)


def test_checks_per_entity(spark):
    rows = clean_rows("a") + [("b", q, *r[2:]) for q, r in zip(QUARTERS, mutate(0, "principal", 1.5))]
    p = quarter_panel(spark, rows)
    out = {(r.k, r.check_name): r.violations
           for r in quality_checks(p, ["k"], floor="2020-01-01", as_of="2023-06-30", min_periods=12).collect()}
    assert out[("a", "principal:not whole")] == 0
    assert out[("b", "principal:not whole")] == 1


def test_gate_counts_every_failure(spark, tmp_path):
    rows = [(f"k{i:03d}", *r[1:]) for i in range(60) for r in mutate(2, "principal", 100.5)]
    checks = quality_checks(quarter_panel(spark, rows), ["k"], floor="2020-01-01", as_of="2023-06-30", min_periods=12)
    with pytest.raises(GateError, match="principal:not whole: 60 violations in 60 entities"):
        gate(checks, report=str(tmp_path / "failed"))
    assert spark.read.parquet(str(tmp_path / "failed")).count() == 60


def test_null_flag_does_not_close(spark):
    bridge = spark.createDataFrame([("a", True), ("a", None), ("b", True), ("b", False)], "k string, closes boolean")
    got = {r["k"]: r["violations"] for r in closure_violations(bridge, ["k"]).collect()}
    assert got == {"a": 1, "b": 1}
