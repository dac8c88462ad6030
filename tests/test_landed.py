"""Wide rows as maps, sources against each other, hashes kept over runs, the audit's tables."""

import re

import pytest
from pyspark.sql import functions as F

from panelsplit.operators import profile as PF
from panelsplit.operators import reconcile as RC
from panelsplit.operators import reshape as RS
from panelsplit.plans.queries import QUERIES
from tests.conftest import SF_SMALL, quarter_panel
from tests.test_plans import plan

MEASURES = ["principal", "supplementary", "billings", "rollover", "write_offs", "rate_pct"]


def panel_of(spark, quarters, missing=()):
    """{entity: [quarters]} to a panel; ``missing``: (entity, quarter, column index in the row) without a value."""
    rows = []
    for k, qs in quarters.items():
        for i, q in enumerate(qs):
            row = [k, q, 10.0 + i, 5.0, 100.5 + i, 50.25, 2.0, 4.0]
            rows.append(tuple(None if (k, q, c) in missing else v for c, v in enumerate(row)))
    return quarter_panel(spark, rows)


Y20 = ["2020-01-01", "2020-04-01", "2020-07-01", "2020-10-01"]
Y21 = ["2021-01-01", "2021-04-01", "2021-07-01", "2021-10-01"]


def test_maps_with_different_labels_round_trip(spark):
    panel = panel_of(spark, {"a": Y20, "b": Y21[:2], "c": ["1999-10-01"]}, missing={("a", "2020-04-01", 5), ("b", "2021-01-01", 2)})
    maps = RS.panel_to_maps(panel, ["k"], {m: m for m in MEASURES})
    got = {(r["k"], r["series"]): r["cells"] for r in maps.collect()}
    assert got["c", "billings"] == {"19994Q": "100.5"} and set(got["a", "rollover"]) == {"20201Q", "20203Q", "20204Q"}
    back = RS.stage_maps(maps, ["k"], {m: m for m in MEASURES}).select("k", "period", *MEASURES)
    want = panel.select("k", "period", *MEASURES)
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0


def test_writing_cells_compiles(spark):
    """Seven columns' plain text in one generated method was too long to compile, and ran interpreted."""
    panel = spark.range(3).selectExpr(
        "id k", "date'2020-01-01' period", "id principal", "id supplementary", "cast(id / 3 as decimal(28,2)) billings", "cast(id * 100 as decimal(28,2)) rollover",
        "cast(id / 7 as decimal(38,4)) write_offs", "id / 3e9D rate_pct")
    series = {**{m: m for m in MEASURES}, "orders_value": "billings"}
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        maps = {(r["k"], r["series"]): r["cells"]["20201Q"] for r in RS.panel_to_maps(panel, ["k"], series).collect()}
        long = {(r["k"], r["series"]): r["value"] for r in RS.panel_to_long(panel, ["k"], series).collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert maps == long and len(maps) == 21
    assert [maps[2, m] for m in series] == ["2", "2", "0.67", "200", "0.2857", "0.0000000006666666666666666", "0.67"]


def test_map_accounting_reconciles(spark):
    maps = spark.createDataFrame(
        [("a", "billings", {"20201Q": "1", "20202Q": " ", "2020XQ": "3"}), ("a", "rollover", {"20201Q": "x"}), ("a", "other", {"20201Q": "5"})],
        "k string, series string, cells map<string,string>")
    mapping = {"billings": "billings", "rollover": "rollover"}
    staged = RS.stage_maps(maps, ["k"], mapping)
    r = RS.map_accounting(maps, staged, ["k"], mapping).collect()[0]
    # Three labels times three series; a malformed label, a text and an unexpected series are left out.
    assert (r.raw_cells, r.present_cells, r.missing_cells, r.excluded_cells, r.staged_cells) == (9, 4, 5, 3, 1)
    assert (r.rule_1, r.rule_2, r.rule_3) == (1, 1, 1) and r.reconciles


def test_maps_need_no_label_discovery(spark):
    p = plan(QUERIES["unpivot_stage"](spark, SF_SMALL))
    assert p.count("lineitem.parquet]") == 1 and p.count("orders.parquet]") == 1


ANNUAL = [("a", "billings", 2020, 408.0), ("a", "rollover", 2020, 50.25), ("a", "billings", 2021, 408.0), ("a", "rollover", 2021, 50.25),
          ("b", "billings", 2020, 408.0), ("b", "rollover", 2020, None), ("c", "billings", 2020, 1.0)]


@pytest.mark.parametrize("edit, want", [
    (None, {("a", 2020): "ok", ("a", 2021): "pending", ("b", 2020): "pending", ("c", 2020): "pending"}),
    ((0, 408.09), {("a", 2020): "ok"}), ((0, 408.2), {("a", 2020): "differs"}), ((1, 50.26), {("a", 2020): "differs"}), ((4, 500.0), {("b", 2020): "differs"})])
def test_years_of_two_sources(spark, edit, want):
    panel = panel_of(spark, {"a": Y20 + Y21[:3], "b": Y20})
    rows = [(*r[:3], edit[1]) if edit and i == edit[0] else r for i, r in enumerate(ANNUAL)]
    annual = spark.createDataFrame(rows, "k string, series string, year bigint, value double")
    got = {(r["k"], r["year"]): r["status"] for r in RC.reconcile_years(panel, annual, ["k"], {"billings": "billings"}, {"rollover": "rollover"}).collect()}
    base = {("a", 2020): "ok", ("a", 2021): "pending", ("b", 2020): "pending", ("c", 2020): "pending"}
    assert got == {**base, **want}


def test_one_changed_cell_names_its_bucket(spark, tmp_path):
    path = str(tmp_path / "hashes")
    df = spark.range(2000).select("id", (F.col("id") * 2).alias("v"))
    first = PF.record_hashes(df, ["id"], path, "t", 16).collect()
    assert len(first) == 16 and all(r["changed"] and r["rows_before"] == 0 for r in first)
    assert not any(r["changed"] for r in PF.record_hashes(df.repartition(7), ["id"], path, "t", 16).collect())
    edited = df.withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v")))
    changed = [r["bucket"] for r in PF.record_hashes(edited, ["id"], path, "t", 16).collect() if r["changed"]]
    assert changed == [spark.range(77, 78).select(F.pmod(F.xxhash64("id"), F.lit(16))).collect()[0][0]]
    gone = [r for r in PF.record_hashes(edited.where("id <> 77"), ["id"], path, "t", 16).collect() if r["changed"]]
    assert [(r["bucket"], r["rows_before"] - r["rows"]) for r in gone] == [(changed[0], 1)]
    assert all(r["run"] == 1 for r in PF.record_hashes(df, ["id"], path, "another", 16).collect())


def test_bucket_hashes_add_up_to_the_table(spark):
    df = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("v"))
    whole = PF.table_hash(df).collect()[0]
    parts = PF.bucket_hashes(df, ["id"], 8).agg(F.sum(F.col("content_hash").cast("decimal(38,0)")).cast("string").alias("h"), F.sum("rows").alias("n")).collect()[0]
    assert (parts["h"], parts["n"]) == (whole["content_hash"], whole["rows"])


def test_audit_tables(spark):
    panel = panel_of(spark, {"a": Y20 + ["2021-01-01", "2021-07-01"]}, missing={("a", "2021-07-01", 4)})
    got = {(r["section"], r["subject"], r["item"]): r["value"] for r in RC.audit_tables(panel, ["k"], recent=3).collect()}
    assert got["year", "2020", "sum billings"] == 408.0 and ("year", "2021", "sum billings") not in got
    assert got["year", "2021", "quarters"] == 2 and got["year", "2020", "fourth quarter rollover"] == 50.25
    assert got["entity", "", "gaps"] == 1 and got["entity", "", "missing billings"] == 1 and got["entity", "", "periods"] == 6
    assert {s for x, s, _ in got if x == "recent"} == {"2021-01-01", "2021-07-01"}
    assert got["quarter", "Q1", "mean rate"] == 4.0
    assert len(RC.audit_tables(panel.drop("k"), [], recent=3).collect()) == len(got)


def test_audit_reads_the_panel_once(spark):
    p = plan(QUERIES["audit_tables"](spark, SF_SMALL))
    assert p.count("lineitem.parquet]") == 1


def test_sensitivity_is_one_pass(spark):
    """One exchange by entity; nothing is joined or exchanged after the windows."""
    p = plan(QUERIES["sensitivity"](spark, SF_SMALL)).split("== Physical Plan ==")[1].split("\n\n\n")[0]
    above = p[:p.index("Window")]
    assert "Join" not in above and "Exchange" not in above
    full = plan(QUERIES["sensitivity"](spark, SF_SMALL))
    assert full.count("lineitem.parquet]") == 1 and not re.search(r"RDDScan|ExistingRDD", full)
