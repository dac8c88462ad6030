"""Golden end-to-end test on the real national series (one entity, keys=[]):
wide quarterly file -> staged panel -> checks -> yearly bridge, sensitivity
table and book split, compared with the published figures.

Published tables are rounded for display, and rounding at ties is noise in
them (6089.625 is shown as 6089.62), so each value is compared within half a
unit of its last printed digit; headline terms are also compared at full
precision.
"""

import os

import pytest
from pyspark.sql import functions as F

from panelsplit.operators import checks as K
from panelsplit.operators import decompose as D
from panelsplit.operators.reshape import stage_wide
from panelsplit.operators.sensitivity import sensitivity
from panelsplit.sources.files import read_annual_long, read_wide

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures", "cards")

# Series names in the source files -> panel columns.
SERIES = {
    "Principal Cardholders": "principal",
    "Supplementary Cardholders": "supplementary",
    "Total Card Billings": "billings",
    "Rollover Balance": "rollover",
    "Bad Debts Written Off": "write_offs",
    "Charge-Off Rates": "rate_pct",
}
# Annual series -> published-table columns.
PUBLISHED = {
    "Total Card Billings": "pub_billings",
    "Bad Debts Written Off": "pub_write_offs",
    "Rollover Balance": "pub_rollover_ye",
    "Principal Cardholders": "pub_principal_ye",
    "Charge-Off Rates": "pub_rate_pct",
}

# Published yearly bridge. year, previous year, write-offs, average rollover,
# rate %, published annual rate %, change, volume, rate, interaction, check, status.
YEARLY_BRIDGE = [
    (2016, 2015, 296.5, 6089.62, 4.869, 4.9, -44.3, 5.24, -49.54, 0.0, -44.3, "checked"),
    (2017, 2016, 288.3, 6085.6, 4.737, 4.7, -8.2, -0.19, -8.01, 0.0, -8.2, "checked"),
    (2018, 2017, 366.5, 6121.3, 5.987, 6.0, 78.2, 1.91, 76.29, 0.0, 78.2, "checked"),
    (2019, 2018, 364.9, 6239.18, 5.849, 5.8, -1.6, 6.98, -8.58, 0.0, -1.6, "checked"),
    (2020, 2019, 396.7, 5601.88, 7.082, 7.1, 31.8, -41.2, 73.0, 0.0, 31.8, "checked"),
    (2021, 2020, 234.6, 5231.02, 4.485, 4.5, -162.1, -21.45, -140.65, 0.0, -162.1, "checked"),
    (2022, 2021, 201.9, 5708.5, 3.537, 3.5, -32.7, 19.15, -51.85, 0.0, -32.7, "checked"),
    (2023, 2022, 270.4, 6728.45, 4.019, 4.0, 68.5, 38.53, 29.97, 0.0, 68.5, "checked"),
    (2024, 2023, 423.2, 7785.47, 5.436, 5.4, 152.8, 49.97, 102.83, 0.0, 152.8, "checked"),
    (2025, 2024, 519.7, 8920.3, 5.826, 5.8, 96.5, 63.9, 32.6, 0.0, 96.5, "checked"),
]
BRIDGE_DIGITS = (None, None, 1, 2, 3, 1, 1, 2, 2, 2, 1, None)
BRIDGE_COLS = ("year", "previous_year", "write_offs", "avg_rollover", "rate_pct", "rate_pct_pub_annual",
               "delta_write_offs", "volume", "rate", "interaction", "check", "annual_crosscheck_status")

# Published sensitivity table. variant, window old, window new, write-offs old,
# new, change, volume, rate, joint (None = blank), residual, rate old %, rate new %.
SENSITIVITY = [
    ("base", "2024-01 → 2024-10", "2025-01 → 2025-10", 423.2, 519.7, 96.5, 63.9, 32.6, 0.0, 0.0, 5.44, 5.83),
    ("peak", "2019-01 → 2019-10", "2020-01 → 2020-10", 364.9, 396.7, 31.8, -41.2, 73.0, 0.0, 0.0, 5.85, 7.08),
    ("trailing4", "2024-07 → 2025-04", "2025-07 → 2026-04", 464.1, 543.4, 79.3, 58.44, 20.86, 0.0, 0.0,
     5.55, 5.79),
    ("same2", "2025-01 → 2025-04", "2026-01 → 2026-04", 250.7, 274.4, 23.7, 27.23, -3.53, 0.0, 0.0, 5.83, 5.75),
    ("published", "2024", "2025", 423.2, 519.7, 96.5, 63.55, 33.41, None, -0.46, 5.4, 5.8),
    ("base_weighted", "2024", "2025", 423.2, 519.7, 96.5, 61.69, 30.38, 4.43, 0.0, 5.44, 5.83),
]
SENS_COLS = ("write_offs_old", "write_offs_new", "delta", "volume", "rate", "joint", "residual",
             "rate_old_pct", "rate_new_pct")

# Full-precision headline (2025 vs 2024) and the 2025 count effects of the
# book split (average total, average principal, year-end total, year-end principal).
HEADLINE_VOLUME, HEADLINE_RATE = 63.900864520285, 32.599135479715
COUNT_EFFECTS_2025 = (-31.808419822455, 30.148644653896, -228.378909802536, -194.779180682559)
# Published metrics. Trailing-4 write-offs at 2026 Q2 and the y/y change of the
# rate there; peak year; write-offs per principal card 2024 -> 2025 and its % change; the
# largest one-quarter move of principal cards (2025 Q2 -> Q3, % change); pooled Q1-Q4 rate means.
TRAILING4_2026Q2, RATE_YOY_2026Q2 = 543.4, -0.1
PEAK_YEAR = 2020
PER_PRINCIPAL_2024, PER_PRINCIPAL_2025, PER_PRINCIPAL_CHANGE_PCT = 68.3, 83.5, 22.4
LARGEST_PRINCIPAL_MOVE = ("2025-04-01", "2025-07-01", -4.0)
POOLED_QUARTER_RATE_MEANS = (5.34, 5.29, 5.51, 5.25)
# Audit profile. Per series (min, max) over the 47 quarters; supplementary cards:
# declining years of 10 year pairs and the % change over the decade; 2025 vs 2024 average total
# cards (% change) and rollover per reported card (% change).
SERIES_RANGE = {
    "principal": (5231538, 6349360),
    "supplementary": (863831, 1343358),
    "billings": (10618.7, 27992.2),
    "rollover": (5148.9, 9640.8),
    "write_offs": (47.3, 138.1),
    "rate_pct": (3.4, 9.1),
}
SUPPLEMENTARY_DECLINES, SUPPLEMENTARY_DECADE_PCT = (10, 10), -32.0
AVG_TOTAL_CARDS_2025_PCT, ROLLOVER_PER_CARD_2025_PCT = -0.4, 15.0
# Audit cross-checks per year. Recomputed annual rate %; quarterly sum minus the
# annual file for write-offs and billings; rollover Q4 and four-quarter average, principal cards Q4
# and four-quarter average.
RECOMPUTED_RATE = {2015: 5.69, 2016: 4.87, 2017: 4.74, 2018: 5.99, 2019: 5.85, 2020: 7.08, 2021: 4.48,
                   2022: 3.54, 2023: 4.02, 2024: 5.44, 2025: 5.83}
FLOW_GAPS = {2015: (-0.1, 0.1), 2016: (0.0, 0.0), 2017: (0.1, 0.1), 2018: (0.0, 0.0), 2019: (0.0, -0.1),
             2020: (-0.1, 0.0), 2021: (0.0, 0.0), 2022: (0.0, 0.0), 2023: (0.1, -0.1), 2024: (0.0, 0.1),
             2025: (-0.1, 0.0)}
STOCKS = {2024: (8298.8, 7785.5, 6271929, 6200077), 2025: (9400.2, 8920.3, 6135494, 6222499)}
# Published-rate basis minus recomputed split, 2025 vs 2024 (volume, rate), and
# the basis-and-rounding residual.
PUBLISHED_BASIS_2025 = (-0.350664520285, 0.812414520285, -0.46175)


def close(a, b, digits):
    return b is None and a is None or a is not None and abs(a - b) <= 0.51 * 10 ** -digits + 1e-9


@pytest.fixture(scope="module")
def panel(spark):
    wide = read_wide(spark, os.path.join(HERE, "quarterly.csv")).drop("source_file")
    return stage_wide(wide, [], SERIES, series_col="DataSeries").cache()


@pytest.fixture(scope="module")
def published(spark):
    long = read_annual_long(spark, os.path.join(HERE, "annual.csv"), id_col="DataSeries")
    return (long.where(F.col("series").isin(list(PUBLISHED)))
            .groupBy("year").pivot("series", list(PUBLISHED)).agg(F.first("value"))
            .select("year", *[F.col(f"`{s}`").alias(c) for s, c in PUBLISHED.items()]))


def test_staged_panel_passes_every_check(panel):
    assert panel.count() == 47
    checks = K.quality_checks(panel, [], floor="2014-01-01", as_of="2026-10-03", min_periods=40)
    got = {r.check_name: r.violations for r in checks.collect()}
    assert len(got) >= 9 and set(got.values()) == {0}, got


def test_yearly_bridge_matches_published(panel, published):
    rows = {r.year: r for r in D.yearly_bridge(panel, [], published).collect()}
    assert sorted(rows) == [g[0] for g in YEARLY_BRIDGE]
    for g in YEARLY_BRIDGE:
        r = rows[g[0]]
        for col, want, digits in zip(BRIDGE_COLS, g, BRIDGE_DIGITS):
            got = r[col]
            assert (got == want) if digits is None else close(got, want, digits), (g[0], col, got, want)
    h = rows[2025]
    assert h.volume == pytest.approx(HEADLINE_VOLUME, abs=1e-9)
    assert h.rate == pytest.approx(HEADLINE_RATE, abs=1e-9)
    assert h.interaction == 0.0 and h.closes


def test_sensitivity_matches_published(panel, published):
    rows = {r.variant_id: r for r in sensitivity(panel, [], published).collect()}
    assert set(rows) == {g[0] for g in SENSITIVITY}
    for g in SENSITIVITY:
        r = rows[g[0]]
        assert (r.window_old, r.window_new) == (g[1], g[2]), g[0]
        for col, want in zip(SENS_COLS, g[3:]):
            digits = 1 if col.startswith("write_offs") or col == "delta" else 2
            assert close(r[col], want, digits), (g[0], col, r[col], want)


def test_book_split_count_effects(panel):
    r = {x.year: x for x in D.book_split(panel, []).collect()}[2025]
    got = (r.count_effect, r.principal_count_effect, r.year_end_count_effect, r.year_end_principal_count_effect)
    for a, b in zip(got, COUNT_EFFECTS_2025):
        assert a == pytest.approx(b, abs=1e-9)


def test_published_basis_differences(panel, published):
    r = {x.year: x for x in D.bridge_with_rates(panel, published, []).collect()}[2025]
    got = (r.volume_vs_recomputed, r.rate_vs_recomputed, r.residual)
    for a, b in zip(got, PUBLISHED_BASIS_2025):
        assert a == pytest.approx(b, abs=1e-9)


def test_reconciles_with_the_annual_table(panel, published):
    """Recomputed annual rates within 0.05 pt of the published ones (11 years),
    summed quarterly flows within 0.1 of the annual flows, year-end stocks
    equal to the fourth quarter exactly."""
    from panelsplit.operators import reconcile as RC
    rate = RC.rate_reconcile(panel, published, []).collect()[0]
    assert rate.comparable_years == 11 and rate.max_abs_diff <= 0.05
    fs = RC.flow_stock_reconcile(panel, published, []).collect()[0]
    assert fs.overlap_years == 11 and fs.max_flow_gap <= 0.1 + 1e-9 and fs.max_stock_gap == 0.0


# --------------------------------------------------------------------------- mutations of the real file

def _mutated(tmp_path, series, value):
    """The quarterly file with the newest cell of ``series`` replaced by ``value``."""
    lines = open(os.path.join(HERE, "quarterly.csv"), encoding="utf-8").read().splitlines()
    out = []
    for line in lines:
        cells = line.split(",")
        if cells[0] == series:
            cells[1] = value
        out.append(",".join(cells))
    path = tmp_path / "quarterly.csv"
    path.write_text("\n".join(out) + "\n", encoding="utf-8")
    return str(path)


def _stage_and_check(spark, path):
    from panelsplit.operators.reshape import cell_accounting
    wide = read_wide(spark, path).drop("source_file")
    staged = stage_wide(wide, [], SERIES, series_col="DataSeries")
    checks = {r.check_name: r.violations for r in
              K.quality_checks(staged, [], floor="2014-01-01", as_of="2026-10-03", min_periods=40).collect()}
    cells = cell_accounting(wide, staged, [], SERIES, series_col="DataSeries").collect()[0]
    return checks, cells


def test_clean_file_cell_accounting(spark):
    _, cells = _stage_and_check(spark, os.path.join(HERE, "quarterly.csv"))
    assert (cells.raw_cells, cells.missing_cells, cells.staged_cells) == (282, 0, 282) and cells.reconciles


def test_fractional_count_is_caught(spark, tmp_path):
    checks, _ = _stage_and_check(spark, _mutated(tmp_path, "Principal Cardholders", "100.5"))
    assert checks["principal:not whole"] == 1
    assert sum(checks.values()) == 1


def test_blank_cell_is_caught_and_accounted(spark, tmp_path):
    checks, cells = _stage_and_check(spark, _mutated(tmp_path, "Rollover Balance", ""))
    assert checks["rollover:missing"] == 1
    assert (cells.raw_cells, cells.missing_cells, cells.staged_cells) == (282, 1, 281) and cells.reconciles


@pytest.mark.parametrize("value", ["NaN", "Infinity", "-Infinity"])
@pytest.mark.parametrize("series", list(SERIES))
def test_non_finite_value_is_caught(spark, tmp_path, series, value):
    checks, _ = _stage_and_check(spark, _mutated(tmp_path, series, value))
    assert checks[f"{SERIES[series]}:not finite"] == 1


def test_header_mutations_of_the_real_file(spark, tmp_path):
    """One job over several landed variants of the real file: the clean and the
    column-reversed file pass; a malformed label and a duplicated quarter
    column are caught, each in its own file only."""
    from panelsplit.operators import landing as L
    rows = [line.split(",") for line in
            open(os.path.join(HERE, "quarterly.csv"), encoding="utf-8").read().splitlines()]
    variants = {
        "clean": rows,
        "reversed": [[r[0], *reversed(r[1:])] for r in rows],
        "malformed": [[r[0], "2026XQ" if i == 0 else r[1], *r[2:]] for i, r in enumerate(rows)],
        "duplicated": [[*r, r[9]] for r in rows],
    }
    for name, rs in variants.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(",".join(r) for r in rs) + "\n", encoding="utf-8")
    glob = str(tmp_path / "*.csv")
    got = {}
    for r in L.file_checks(spark, glob, "DataSeries", L.QUARTER, list(SERIES), False, 40).collect():
        got.setdefault(os.path.basename(r.path).split(".")[0], {})[r.check_name] = r.violations
    assert set(got["clean"].values()) == {0} and set(got["reversed"].values()) == {0}
    assert got["malformed"]["malformed labels"] == 1
    assert sum(v for k, v in got["malformed"].items() if k != "malformed labels") == 0, got["malformed"]
    assert got["duplicated"]["duplicate labels"] == 1
    assert sum(v for k, v in got["duplicated"].items() if k != "duplicate labels") == 0, got["duplicated"]


def test_metrics_match_published(panel, published):
    from panelsplit.operators import metrics as M
    q = {str(r.period): r for r in
         M.yoy_change(M.trailing_sum(panel, [], "write_offs"), [], "rate_pct").collect()}["2026-04-01"]
    assert close(q.write_offs_4q, TRAILING4_2026Q2, 1) and q.write_offs_4q == q.write_offs_4q_contiguous
    assert close(q.rate_pct_yoy_checked, RATE_YOY_2026Q2, 1)
    peak = M.peak_period(panel, [], published).collect()[0]
    assert (peak.peak_year, peak.peak_basis) == (PEAK_YEAR, "published")
    pu = {r.year: r for r in M.per_unit(panel, []).collect()}
    assert close(pu[2024].loss_per_principal, PER_PRINCIPAL_2024, 1)
    assert close(pu[2025].loss_per_principal, PER_PRINCIPAL_2025, 1)
    assert close(pu[2025].loss_per_principal_change_pct, PER_PRINCIPAL_CHANGE_PCT, 1)
    mv = M.largest_move(panel, [], "principal").collect()[0]
    assert (str(mv.from_period), str(mv.to_period)) == LARGEST_PRINCIPAL_MOVE[:2]
    assert close(mv.change_pct, LARGEST_PRINCIPAL_MOVE[2], 1)
    means = {r.quarter_of_year: r.mean_rate_pct for r in M.seasonal_means(panel, [], "rate_pct").collect()}
    for qtr, want in zip((1, 2, 3, 4), POOLED_QUARTER_RATE_MEANS):
        assert close(means[qtr], want, 2), (qtr, means[qtr], want)


def test_every_operator_accepts_empty_keys(spark, panel, published):
    """Whole-table use (keys=[]) of every panel operator on the real series."""
    from panelsplit.operators import chartdata as C
    from panelsplit.operators import metrics as M
    from panelsplit.operators import panel as P
    from panelsplit.operators import reconcile as RC
    from panelsplit.operators import sensitivity as SE
    bridge = D.yearly_bridge(panel, [], published)
    raw = P.annual_metrics(panel, []).select("year", F.col("write_offs").alias("raw_w"),
                                             F.col("avg_rollover").alias("raw_r"))
    windows = P.year_windows(spark.range(1).select(F.lit(2024).alias("year")))
    expected_rows = {
        "annual_metrics": (P.annual_metrics(panel, []), 11), "annual_book": (P.annual_book(panel, []), 11),
        "window_stats": (P.window_stats(panel, windows, []), 1),
        "trailing_sum": (M.trailing_sum(panel, [], "write_offs"), 47),
        "trailing_by_sequence": (M.trailing_by_sequence(panel, [], "write_offs"), 47),
        "first_full_window": (M.first_full_window(panel, [], "write_offs"), 1),
        "recent_periods": (M.recent_periods(panel, []), 4),
        "series_profile": (M.series_profile(panel, [], ["principal", "rate_pct"]), 2),
        "decline_count": (M.decline_count(panel, [], "supplementary"), 1), "rate_path": (M.rate_path(panel, []), 1),
        "base_weighted": (D.base_weighted_bridge(panel, []), 10),
        "bridge_between": (D.bridge_between(panel, [], 2022, 2025), 1),
        "comparison_pairs": (SE.comparison_pairs(panel, [], published), 3),
        "sensitivity_status": (SE.sensitivity_status(panel, [], published), 6),
        "closure_violations": (K.closure_violations(bridge, []), 1),
        "freshness": (K.freshness(panel, [], "2026-10-03"), 1),
        "hand_check": (RC.hand_check(panel, raw, []), 11), "coverage": (RC.coverage(panel, []), 1),
        "source_overlap": (RC.source_overlap(panel, published, []), 0),
        "waterfall": (C.waterfall(bridge, []), 40), "signed_stack": (C.signed_stack(bridge, []), 20),
    }
    got = {name: df.count() for name, (df, _) in expected_rows.items()}
    assert got == {name: n for name, (_, n) in expected_rows.items()}


def test_audit_profile_matches_published(panel):
    from panelsplit.operators import metrics as M
    prof = {r.series: r for r in M.series_profile(panel, [], list(SERIES_RANGE)).collect()}
    for name, (lo, hi) in SERIES_RANGE.items():
        r = prof[name]
        assert (r.min_value, r.max_value, r.nulls, r.periods) == (lo, hi, 0, 47), name
    d = M.decline_count(panel, [], "supplementary").collect()[0]
    assert (d.declining_years, d.year_pairs) == SUPPLEMENTARY_DECLINES
    assert close(d.endpoint_change_pct, SUPPLEMENTARY_DECADE_PCT, 0)
    book = {r.year: r for r in D.book_split(panel, []).collect()}
    assert close(book[2025].avg_total_change_pct, AVG_TOTAL_CARDS_2025_PCT, 1)
    per_card = (book[2025].rollover_per_unit / book[2024].rollover_per_unit - 1) * 100
    assert close(per_card, ROLLOVER_PER_CARD_2025_PCT, 0)


def test_audit_cross_checks_match_published(panel, published):
    from panelsplit.operators import panel as P
    from panelsplit.operators import reconcile as RC
    annual = {r.year: r for r in P.annual_metrics(panel, []).collect()}
    assert sorted(annual) == sorted(RECOMPUTED_RATE)
    for y, want in RECOMPUTED_RATE.items():
        assert close(annual[y].rate_pct_recomputed, want, 2), (y, annual[y].rate_pct_recomputed)
    pub = {r.year: r for r in published.collect()}
    sums = {r.year: r for r in RC.quarterly_sums(panel, []).collect()}
    for y, (dw, db) in FLOW_GAPS.items():
        assert close(sums[y].q_write_offs - pub[y].pub_write_offs, dw, 2), y
        assert close(sums[y].q_billings - pub[y].pub_billings, db, 2), y
    book = {r.year: r for r in D.book_split(panel, []).collect()}
    for y, (r_q4, r_avg, p_q4, p_avg) in STOCKS.items():
        assert sums[y].q4_rollover == r_q4 and close(annual[y].avg_rollover, r_avg, 1)
        assert sums[y].q4_principal == p_q4 and close(book[y].avg_principal, p_avg, 0)
