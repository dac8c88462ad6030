"""The published annual table rolled up from a quarterly panel: flows and the
rate only for four-quarter years, stocks at the fourth quarter (NULL when the
year has no fourth quarter or the value is missing there)."""

import pytest

from panelsplit.plans.facts import published_annual
from tests.conftest import quarter_panel

# (key, quarter start, principal, supplementary, billings, rollover, write_offs, rate_pct)
ROWS = [
    ("a", "2000-01-01", 10.0, 1.0, 100.0, 40.0, 2.0, 1.0),
    ("a", "2000-04-01", 11.0, 1.0, 110.0, 44.0, 3.0, 1.0),
    ("a", "2000-07-01", 12.0, 1.0, 120.0, 48.0, 4.0, 1.0),
    ("a", "2000-10-01", 13.0, 1.0, 130.0, None, 5.0, 1.0),   # year-end balance missing
    ("a", "2001-01-01", 14.0, 1.0, 140.0, 56.0, 6.0, 1.0),   # partial year
    ("a", "2001-04-01", 15.0, 1.0, 150.0, 60.0, 7.0, 1.0),
    ("b", "2000-04-01", 20.0, 2.0, 200.0, 80.0, 8.0, 1.0),   # three quarters, with Q4
    ("b", "2000-07-01", 21.0, 2.0, 210.0, 84.0, 9.0, 1.0),
    ("b", "2000-10-01", 22.0, 2.0, 220.0, 88.0, 10.0, 1.0),
]


def test_rollup_rules(spark):
    out = {(r.k, r.year): r for r in published_annual(quarter_panel(spark, ROWS), ["k"]).collect()}
    assert set(out) == {("a", 2000), ("a", 2001), ("b", 2000)}
    a0 = out[("a", 2000)]
    assert a0.pub_billings == 460.0 and a0.pub_write_offs == 14.0
    assert a0.pub_rollover_ye is None and a0.pub_principal_ye == 13.0
    assert a0.pub_rate_pct == pytest.approx(round(14.0 * 100 / (132.0 / 4), 1))
    a1 = out[("a", 2001)]
    assert a1.pub_billings is None and a1.pub_write_offs is None and a1.pub_rate_pct is None
    assert a1.pub_rollover_ye is None and a1.pub_principal_ye is None
    b0 = out[("b", 2000)]
    assert b0.pub_billings is None and b0.pub_rate_pct is None
    assert b0.pub_rollover_ye == 88.0 and b0.pub_principal_ye == 22.0


def test_rollup_equals_direct_year_aggregate_on_a_sparse_key(spark):
    """Per customer (gaps, partial years, missing fourth quarters) the roll-up
    of the panel equals the year-grain aggregate straight from the facts
    (the oracle's formulation, run in DuckDB)."""
    import duckdb

    from panelsplit.plans import sqlparts as S
    from panelsplit.plans.facts import fact_panel
    from panelsplit.sources.tables import table_path
    from tests.conftest import SF_SMALL

    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    direct = {(r[0], r[1]): r[2:] for r in
              con.sql("WITH " + S.published_cte(["o_custkey"]) + " SELECT * FROM published").fetchall()}
    keys = ["o_custkey"]
    got = {(r[0], r[1]): tuple(r[2:]) for r in
           published_annual(fact_panel(spark, SF_SMALL, keys, line_level=False), keys).collect()}
    assert len(got) == len(direct) > 500 and set(got) == set(direct)
    assert any(v[2] is None for v in got.values()) and any(v[2] is not None for v in got.values())
    for k, want in direct.items():
        for a, b in zip(got[k], want):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9), (k, got[k], want)
