"""Windows, pairing and aggregates on literal panels."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelsplit.operators import metrics as M
from panelsplit.operators.decompose import pair_consecutive
from panelsplit.operators.panel import annual_metrics
from tests.conftest import quarter_panel

GAPPED = ["2020-01-01", "2020-04-01", "2020-07-01", "2020-10-01", "2021-04-01", "2021-07-01", "2021-10-01"]


def rows_for(quarters, key="a", wo=lambda i: float(i + 1)):
    return [(key, q, 10.0, 5.0, 100.0, 50.0, wo(i), 3.0) for i, q in enumerate(quarters)]


def test_rows_vs_range_with_gap(spark):
    p = quarter_panel(spark, rows_for(GAPPED))
    out = {str(r.period): r for r in M.trailing_sum(p, ["k"], "write_offs").collect()}
    assert out["2020-10-01"].write_offs_4q == 10.0 and out["2020-10-01"].write_offs_4q_contiguous == 10.0
    # ROWS counts four rows across the gap, RANGE sees only three quarters
    assert out["2021-04-01"].write_offs_4q == 14.0
    assert out["2021-04-01"].write_offs_4q_contiguous is None
    assert out["2020-07-01"].write_offs_4q is None


def test_sequence_formulation_equals_window(spark):
    p = quarter_panel(spark, rows_for(GAPPED) + rows_for(GAPPED[:5], key="b"))
    t = M.trailing_sum(p, ["k"], "write_offs", name="t")
    s = M.trailing_by_sequence(t, ["k"], "write_offs")
    assert s.where(~F.col("write_offs_4q_by_seq").eqNullSafe(F.col("t"))).count() == 0


def test_yoy_checked_needs_exact_lag(spark):
    p = quarter_panel(spark, rows_for(GAPPED + ["2022-01-01", "2022-04-01"]))
    out = {str(r.period): r for r in M.yoy_change(p, ["k"], "write_offs").collect()}
    assert out["2021-07-01"].write_offs_yoy == 4.0                # 6th row minus 2nd row
    assert out["2021-07-01"].write_offs_yoy_checked is None       # 2nd row is 5 quarters back
    assert out["2022-04-01"].write_offs_yoy_checked == 4.0        # 9th row minus 5th: exactly 4 back


def test_annual_null_rule(spark):
    q = [f"2020-{m:02d}-01" for m in (1, 4, 7, 10)] + [f"2021-{m:02d}-01" for m in (1, 4, 7, 10)]
    rows = rows_for(q)
    rows[5] = ("a", q[5], 10.0, 5.0, 100.0, None, 6.0, 3.0)     # rollover missing in 2021 Q2
    a = {r.year: r for r in annual_metrics(quarter_panel(spark, rows), ["k"]).collect()}
    assert a[2020].write_offs == 10.0 and a[2020].avg_rollover == 50.0
    assert a[2020].rate_pct_recomputed == 100.0 * 10.0 / 50.0
    assert a[2021].avg_rollover is None and a[2021].rate_pct_recomputed is None
    assert a[2021].write_offs == 26.0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(range(2000, 2012)), min_size=1, max_size=10, unique=True), st.integers(0, 10 ** 6))
def test_lag_pairing_equals_self_join(spark, years, seed):
    rnd = random.Random(seed)
    rows = [("e", y, rnd.random()) for y in years] + [("f", y, rnd.random()) for y in years[::2]]
    df = spark.createDataFrame(rows, "k string, year long, v double")
    lagged = {(r.k, r.year, r.v0) for r in pair_consecutive(df, ["k"], ["v"]).collect()}
    prev = df.select("k", (F.col("year") + 1).alias("year"), F.col("v").alias("v0"))
    joined = {(r.k, r.year, r.v0) for r in df.join(prev, ["k", "year"]).collect()}
    assert lagged == joined


def test_largest_move_and_peak_ties(spark):
    q = [f"2020-{m:02d}-01" for m in (1, 4, 7, 10)]
    rows = [("a", qq, v, 1.0, 1.0, 1.0, 1.0, 1.0) for qq, v in zip(q, [10.0, 20.0, 10.0, 20.0])]
    m = M.largest_move(quarter_panel(spark, rows), ["k"], "principal").collect()[0]
    assert str(m.from_period) == "2020-07-01" and m.change == 10.0     # ties: the later move
    pub = spark.createDataFrame([("a", 2019, 5.0), ("a", 2020, 5.0)], "k string, year long, pub_rate_pct double")
    q2 = [f"{y}-{mm:02d}-01" for y in (2019, 2020) for mm in (1, 4, 7, 10)]
    p2 = quarter_panel(spark, rows_for(q2))
    pk = M.peak_period(p2, ["k"], pub).collect()[0]
    assert pk.peak_year == 2019 and pk.peak_basis == "published"       # ties: the earliest year


def test_trailing_sum_needs_every_value(spark):
    rows = [("a", f"{y}-{m:02d}-01", 1.0, 1.0, 1.0, 1.0, None if (y, m) == (2020, 7) else 1.0, 1.0) for y in (2020, 2021) for m in (1, 4, 7, 10)]
    p = quarter_panel(spark, rows)
    got = M.trailing_by_sequence(M.trailing_sum(p, ["k"], "write_offs"), ["k"], "write_offs").orderBy("period").collect()
    want = [None] * 6 + [4.0] * 2  # the windows of 2020 Q4 to 2021 Q2 hold the quarter without a value
    for c in ("write_offs_4q", "write_offs_4q_contiguous", "write_offs_4q_by_seq"):
        assert [r[c] for r in got] == want, c
    first = M.first_full_window(p, ["k"], "write_offs").collect()[0]
    assert (first["first_full_seq"], str(first["first_full_period"])) == (7, "2021-07-01")
