"""Wide files: staging, cell accounting and header/row mutations."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelsplit.functions.periods import is_quarter_label, period_from_label
from panelsplit.operators import landing as L
from panelsplit.operators.reshape import cell_accounting, numeric_value, stage_wide
from panelsplit.sources.files import csv_fields, file_hashes, read_wide

SERIES = {"Count A": "principal", "Count B": "supplementary", "Flow B": "billings",
          "Stock R": "rollover", "Flow W": "write_offs", "Rate": "rate_pct"}
LABELS = ["20222Q", "20221Q", "20214Q", "20213Q", "20212Q", "20211Q"]   # newest first


def wide_text(labels=LABELS, cell=lambda s, j: f"{10 + j}.5" if s.startswith("F") else str(100 + j),
              header_id="DataSeries", extra=""):
    lines = [",".join([header_id, *labels])]
    for s in SERIES:
        lines.append(",".join([s, *[cell(s, j) for j in range(len(labels))]]))
    return "\n".join(lines) + "\n" + extra


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_label_rules(spark):
    df = spark.createDataFrame([("20262Q",), ("2026XQ",), ("20265Q",), ("20262Q\n",), ("2026Q2",)], "l string")
    got = [(r.ok, r.p) for r in df.select(is_quarter_label("l").alias("ok"), period_from_label("l").alias("p")).collect()]
    assert [g[0] for g in got] == [True, False, False, False, False]
    assert str(got[0][1]) == "2026-04-01" and all(g[1] is None for g in got[1:])


def test_numeric_value_rejects_type_suffix(spark):
    df = spark.createDataFrame([("1.5",), ("1.0d",), ("5f",), ("NaN",), ("abc",), (" 7 ",)], "v string")
    got = [r.x for r in df.select(numeric_value("v").alias("x")).collect()]
    assert got[0] == 1.5 and got[1] is None and got[2] is None and got[3] != got[3] and got[4] is None
    assert got[5] == 7.0


def test_stage_and_account(spark, tmp_path):
    path = write(tmp_path, "q.csv", wide_text(extra="Unexpected," + ",".join(["1"] * len(LABELS)) + "\n"))
    wide = read_wide(spark, path).drop("source_file").withColumnRenamed("DataSeries", "series")
    staged = stage_wide(wide, [], SERIES)
    assert staged.count() == len(LABELS)
    row = staged.where(F.col("period") == F.lit("2022-04-01").cast("date")).collect()[0]
    assert row.principal == 100.0 and row.billings == 10.5
    acc = cell_accounting(wide, staged, [], SERIES).collect()[0]
    assert acc.raw_cells == 7 * len(LABELS)
    assert acc.excluded_cells == len(LABELS) and acc.rule_3 == len(LABELS)
    assert acc.staged_cells == 6 * len(LABELS) and acc.reconciles


def test_missing_cell_is_counted(spark, tmp_path):
    text = wide_text(cell=lambda s, j: "" if (s == "Stock R" and j == 2) else str(100 + j))
    wide = read_wide(spark, write(tmp_path, "q.csv", text)).drop("source_file").withColumnRenamed("DataSeries", "series")
    staged = stage_wide(wide, [], SERIES)
    acc = cell_accounting(wide, staged, [], SERIES).collect()[0]
    assert acc.missing_cells == 1 and acc.staged_cells == 6 * len(LABELS) - 1 and acc.reconciles


def header_result(spark, tmp_path, text, kind=L.QUARTER):
    glob = write(tmp_path, "h.csv", text)
    out = L.file_checks(spark, glob, "DataSeries", kind, list(SERIES), False, 4).collect()
    return {r.check_name: r.violations for r in out if r.check_name not in ROW_CHECKS}


ROW_CHECKS = ("row width", "numeric cells", "expected series")


def row_result(spark, glob, series, allow_na, kind=L.QUARTER):
    out = L.file_checks(spark, glob, "DataSeries", kind, series, allow_na, 1).collect()
    return {r.check_name: r.violations for r in out if r.check_name in ROW_CHECKS}


def test_header_clean_and_reversed(spark, tmp_path):
    assert sum(header_result(spark, tmp_path, wide_text()).values()) == 0
    assert sum(header_result(spark, tmp_path, wide_text(labels=LABELS[::-1])).values()) == 0


def test_header_malformed_label(spark, tmp_path):
    v = header_result(spark, tmp_path, wide_text(labels=["2026XQ", *LABELS[1:]]))
    assert v["malformed labels"] == 1


@pytest.mark.parametrize("labels", [
    ["20222Q", "20222Q", *LABELS[2:]],          # duplicate pair
    [*LABELS[:-1], LABELS[0]],                  # duplicate at the end
])
def test_header_duplicates(spark, tmp_path, labels):
    v = header_result(spark, tmp_path, wide_text(labels=labels))
    assert v["duplicate labels"] == 1


def test_header_gap_and_id(spark, tmp_path):
    v = header_result(spark, tmp_path, wide_text(labels=["20224Q", *LABELS[1:]], header_id="Series"))
    assert v["labels contiguous"] == 1 and v["first column is the id"] == 1


def test_row_checks(spark, tmp_path):
    text = wide_text(cell=lambda s, j: "x1" if (s == "Rate" and j == 0) else str(j))
    text = text.replace("Count B,", "Count C,")
    glob = write(tmp_path, "r.csv", text + "Flow B,1\n")
    out = row_result(spark, glob, list(SERIES), False)
    # Count B missing, Count C unexpected, Flow B twice: three series off the expected multiset
    assert out["numeric cells"] == 1 and out["row width"] == 1 and out["expected series"] == 3


def test_annual_na_allowed(spark, tmp_path):
    text = "DataSeries,2021,2020\n" + "\n".join(f"{s},1.5,na" for s in SERIES) + "\n"
    glob = write(tmp_path, "a.csv", text)
    out = row_result(spark, glob, list(SERIES), True, L.YEAR)
    assert out["numeric cells"] == 0
    hv = header_result(spark, tmp_path, "DataSeries,2021,2021\n", kind=L.YEAR)
    assert hv["duplicate labels"] == 1


def test_manifest_detects_changed_bytes(spark, tmp_path):
    glob = write(tmp_path, "m.csv", wide_text())
    recorded = L.profile_files(spark, glob, L.QUARTER).collect()
    rec_df = spark.createDataFrame([(r.path, r.sha256) for r in recorded], "path string, sha256 string")
    assert sum(r.violations for r in L.manifest_mismatches(file_hashes(spark, glob), rec_df).collect()) == 0
    write(tmp_path, "m.csv", wide_text().replace("100", "101", 1))
    assert sum(r.violations for r in L.manifest_mismatches(file_hashes(spark, glob), rec_df).collect()) == 1


def test_quoted_comma_and_repeated_header(spark, tmp_path):
    text = "DataSeries,2021,2020\n" + "\n".join(f'"{s}, total",1.5,2' for s in SERIES) + "\n"
    names = [f"{s}, total" for s in SERIES]
    glob = write(tmp_path, "q.csv", text)
    run = lambda g: row_result(spark, g, names, False, L.YEAR)
    assert set(run(glob).values()) == {0}
    again = write(tmp_path, "again.csv", text + "DataSeries,2021,2020\n")
    assert run(again) == {"row width": 0, "numeric cells": 0, "expected series": 1}
    assert {r.rows for r in L.profile_files(spark, again, L.YEAR).collect()} == {len(SERIES) + 1}


def test_many_labels_are_all_profiled(spark, tmp_path):
    labels = [str(1000 + i) for i in range(3000)]
    glob = write(tmp_path, "wide.csv", "DataSeries," + ",".join(labels) + "\n")
    r = L.profile_files(spark, glob, L.YEAR).collect()[0]
    assert (r.labels, r.label_min_idx, r.label_max_idx) == (3000, 1000, 3999)


def test_line_ends_in_quoted_fields(spark, tmp_path):
    text = wide_text().replace("Count B,", '"Count\nB, ""all""",', 1)
    glob = write(tmp_path, "lines.csv", text)
    names = ['Count\nB, "all"' if s == "Count B" else s for s in SERIES]
    assert set(row_result(spark, glob, names, False).values()) == {0}
    r = L.profile_files(spark, glob, L.QUARTER).collect()[0]
    assert r.rows == len(SERIES) and r.series == sorted(names)


def test_empty_and_many_files_in_one_job(spark, tmp_path):
    write(tmp_path, "a.csv", "\n \n")
    write(tmp_path, "b.csv", wide_text())
    glob = write(tmp_path, "c.csv", "DataSeries,20221Q\n")
    out = {}
    for r in L.file_checks(spark, glob.replace("c.csv", "*.csv"), "DataSeries", L.QUARTER, list(SERIES), False, 4).collect():
        out.setdefault(r.path[-5:], {})[r.check_name] = r.violations
    assert set(out["b.csv"].values()) == {0}
    assert out["a.csv"]["expected series"] == out["c.csv"]["expected series"] == len(SERIES)
    assert out["a.csv"]["coverage floor"] == out["c.csv"]["coverage floor"] == 1 and out["a.csv"]["first column is the id"] == 1


def test_latest_label_is_recent(spark, tmp_path):
    glob = write(tmp_path, "f.csv", wide_text())
    latest = max(LABELS)
    year, quarter = int(latest[:4]), int(latest[4])
    for back, want in ((2, 0), (3, 1)):
        index = year * 4 + quarter - 1 + back
        as_of = datetime.date(index // 4, index % 4 * 3 + 1, 1)
        got = {r.check_name: r.violations for r in L.file_checks(spark, glob, "DataSeries", L.QUARTER, list(SERIES), False, 4, as_of).collect()}
        assert got["latest label is recent"] == want


def test_wide_record_fields(spark):
    record = ",".join(["", "a", '"b,c"', '"d ""e"""', "", *map(str, range(20000)), ""])
    got = spark.createDataFrame([(record,)], "r string").select(csv_fields(F.col("r"))).collect()[0][0]
    assert got == ["", "a", "b,c", 'd "e"', "", *map(str, range(20000)), ""]
