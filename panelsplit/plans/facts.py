"""The driver tables as flow/stock panels.

Mapping (orders are the book, lines the transactions):

    billings       (flow)  sum(extended price)
    write_offs     (flow)  sum(extended price * (1 - discount)) of returned lines ('R')
    rollover       (stock) sum(extended price) of open lines ('O')
    principal      (stock) distinct customers with orders in the period
    supplementary  (stock) distinct suppliers on the period's lines
    rate_pct       (rate)  published period rate: round(100 * write_offs / billings, 1)

Money is cast to DECIMAL before summing (exact, order-independent sums).
``period`` is the quarter start of ``o_orderdate``.

The "published annual table" has flows summed (NULL unless all four quarters
exist), stocks at year end (fourth quarter) and the rate recomputed and rounded
to 1 dp. ``published_from_facts`` computes it in a pass of its own, for the
reconciliations; ``published_annual`` rolls it up from a panel. The hand check's
recompute (``raw_annual``) is a separate pass straight from the facts as well.

Join plan: lineitem ⋈ orders on the order key is the one large join (sort-merge
or shuffled hash, chosen by Catalyst/AQE from sizes); customer is joined only
when a key needs a customer column. Only referenced columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import money
from ..functions.periods import quarter_start
from ..operators.panel import build_panel, cluster_by_entity
from ..session import cut_lineage
from ..sources.tables import read_table

LINE_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount",
             "l_returnflag", "l_linestatus")
ORDER_COLS = ("o_orderkey", "o_custkey", "o_orderdate")
CUSTOMER_COLS = ("c_custkey", "c_nationkey", "c_mktsegment")


def order_facts(spark: SparkSession, sf_dir: str, keys: Sequence[str], since: str | None = None) -> DataFrame:
    """lineitem ⋈ orders (⋈ customer when a key needs it), pruned to the
    columns the panel uses. ``since`` (a quarter start) bounds the order date;
    it is a plain column predicate, so it reaches the orders scan as a pushed
    Parquet filter."""
    li = read_table(spark, sf_dir, "lineitem").select(*LINE_COLS)
    od = read_table(spark, sf_dir, "orders").select(*ORDER_COLS)
    if since is not None:
        od = od.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
    facts = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    need_customer = [k for k in keys if k.startswith("c_") and k != "c_custkey"]
    if need_customer:
        cu = read_table(spark, sf_dir, "customer").select("c_custkey", *need_customer)
        facts = facts.join(cu, F.col("o_custkey") == F.col("c_custkey"))
    return facts


def order_level_facts(spark: SparkSession, sf_dir: str, keys: Sequence[str],
                      since: str | None = None) -> DataFrame:
    """Lines pre-aggregated per order *before* the join: one row per order
    with the three money sums, then ⋈ orders (⋈ customer).

    Spark does not push aggregation below a join, so this is written out:
    the per-order partial aggregate runs map-side (lines of an order are
    written together), the shuffle on the order key carries about one row per
    order instead of one per line, and its hash partitioning already
    satisfies the join on the order key. Usable whenever no line-level column
    is needed downstream (no supplier counts, no line-level keys)."""
    li = read_table(spark, sf_dir, "lineitem").select(*LINE_COLS)
    per_order = li.groupBy("l_orderkey").agg(
        F.sum(line_amount()).alias("b"),
        F.sum(F.when(F.col("l_linestatus") == "O", line_amount())).alias("rb"),
        F.sum(F.when(F.col("l_returnflag") == "R", loss_amount())).alias("w"))
    od = read_table(spark, sf_dir, "orders").select(*ORDER_COLS)
    if since is not None:
        od = od.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
    facts = per_order.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    need_customer = [k for k in keys if k.startswith("c_") and k != "c_custkey"]
    if need_customer:
        cu = read_table(spark, sf_dir, "customer").select("c_custkey", *need_customer)
        facts = facts.join(cu, F.col("o_custkey") == F.col("c_custkey"))
    return facts


def _line_keys(keys: Sequence[str]) -> bool:
    return any(k.startswith("l_") for k in keys)


def line_amount() -> Column:
    return money("l_extendedprice")


def loss_amount() -> Column:
    return money("l_extendedprice") * (F.lit(1) - money("l_discount", 4, 2))


def fact_measures() -> dict[str, Column]:
    return {
        "principal": F.countDistinct("o_custkey"),
        "supplementary": F.countDistinct("l_suppkey"),
        "billings": F.sum(line_amount()),
        "rollover": F.sum(F.when(F.col("l_linestatus") == "O", line_amount())),
        "write_offs": F.sum(F.when(F.col("l_returnflag") == "R", loss_amount())),
    }


def published_rate(w, b) -> Column:
    return F.round(F.try_divide(F.col(w).cast("double") * 100, F.col(b).cast("double")), 1)


def fact_panel(spark: SparkSession, sf_dir: str, keys: Sequence[str],
               clustered: bool = True, since: str | None = None, line_level: bool = True,
               materialize: bool = False) -> DataFrame:
    """(keys, period) panel of the order book (periods from ``since`` on).

    ``line_level=False`` builds it from order-level facts (lines
    pre-aggregated per order): same numbers, about a quarter of the join
    shuffle, but without the supplier count, so only for consumers that do
    not need ``supplementary``. Line-level keys force the line-level path.
    ``materialize`` checkpoints the panel into the shared folder: for plans
    that read it from several branches (computed once, lineage cut)."""
    if line_level or _line_keys(keys):
        facts = order_facts(spark, sf_dir, keys, since)
        aggs = fact_measures()
    else:
        facts = order_level_facts(spark, sf_dir, keys, since)
        aggs = {"principal": F.countDistinct("o_custkey"), "billings": F.sum("b"),
                "rollover": F.sum("rb"), "write_offs": F.sum("w")}
    # Counting a column that is a key needs no distinct count: there is one.
    aggs |= {m: F.max(F.lit(1).cast("bigint")) for m, c in (("principal", "o_custkey"), ("supplementary", "l_suppkey")) if c in keys and m in aggs}
    panel = build_panel(facts, keys, quarter_start("o_orderdate"), aggs,
                        post={"rate_pct": published_rate("write_offs", "billings")})
    panel = cluster_by_entity(panel, keys) if clustered else panel
    return cut_lineage(panel) if materialize else panel


def year_facts(spark: SparkSession, sf_dir: str, keys: Sequence[str]) -> DataFrame:
    """Year-grain aggregate straight from the facts (no panel): quarters with
    orders (a 4-bit mask OR-ed per group, then counted: a plain hash
    aggregate, no set collection), the summed loss and the summed open
    balance."""
    if _line_keys(keys):
        facts = order_facts(spark, sf_dir, keys).withColumns({
            "rb": F.when(F.col("l_linestatus") == "O", line_amount()),
            "w": F.when(F.col("l_returnflag") == "R", loss_amount())})
    else:
        facts = order_level_facts(spark, sf_dir, keys)
    return (facts.groupBy(*keys, F.year("o_orderdate").cast("bigint").alias("year"))
            .agg(F.bit_count(F.bit_or(F.expr("shiftleft(1, quarter(o_orderdate) - 1)"))).cast("int").alias("nq"),
                 F.sum("w").alias("w"), F.sum("rb").alias("rb")))


def published_annual(panel: DataFrame, keys: Sequence[str], materialize: bool = False) -> DataFrame:
    """The second, "published" annual table (one row per entity and year with
    any quarter): flows and the rate only for years with four quarters, stocks
    at year end (the fourth quarter's value).

    It is a year-grain roll-up of the quarterly panel, for plans that use
    published rates beside the panel's own and need no second pass over the
    facts. Reconciliations compare the panel with ``published_from_facts``."""
    q4 = F.quarter("period") == 4
    agg = (panel.groupBy(*keys, F.year("period").cast("bigint").alias("year"))
           .agg(F.count(F.lit(1)).alias("nq"), F.sum("billings").alias("b"),
                F.sum("write_offs").alias("w"), F.sum("rollover").alias("rb"),
                F.max(F.when(q4, F.col("rollover"))).alias("rb_ye"),
                F.max(F.when(q4, F.col("principal"))).alias("p_ye"),
                F.max(q4).alias("has_q4")))
    full = F.col("nq") == 4
    out = agg.select(
        *keys, "year",
        F.when(full, F.col("b").cast("double")).alias("pub_billings"),
        F.when(full, F.col("w").cast("double")).alias("pub_write_offs"),
        F.when(F.col("has_q4"), F.col("rb_ye").cast("double")).alias("pub_rollover_ye"),
        F.when(F.col("has_q4"), F.col("p_ye").cast("double")).alias("pub_principal_ye"),
        F.when(full, F.round(F.try_divide(F.col("w").cast("double") * 100,
                                          F.col("rb").cast("double") / 4), 1)).alias("pub_rate_pct"))
    return cut_lineage(out) if materialize else out


def with_published_rate(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The panel with the published annual rate of each row's year (``published_annual``'s, by a window)."""
    year = Window.partitionBy(*keys, F.year("period"))
    rate = F.round(F.try_divide(F.sum("write_offs").over(year).cast("double") * 100, F.sum("rollover").over(year).cast("double") / 4), 1)
    return panel.withColumn("pub_rate_pct", F.when(F.count(F.lit(1)).over(year) == 4, rate))


def published_from_facts(spark: SparkSession, sf_dir: str, keys: Sequence[str]) -> DataFrame:
    """The published annual table straight from the facts, independent of any panel."""
    facts = order_level_facts(spark, sf_dir, keys)
    q4 = F.quarter("o_orderdate") == 4
    agg = (facts.groupBy(*keys, F.year("o_orderdate").cast("bigint").alias("year"))
           .agg(F.bit_count(F.bit_or(F.expr("shiftleft(1, quarter(o_orderdate) - 1)"))).cast("int").alias("nq"),
                F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("rb").alias("rb"),
                F.sum(F.when(q4, F.col("rb"))).alias("rb_ye"),
                F.countDistinct(F.when(q4, F.col("o_custkey"))).alias("p_ye"), F.max(q4).alias("has_q4")))
    full = F.col("nq") == 4
    return agg.select(
        *keys, "year",
        F.when(full, F.col("b").cast("double")).alias("pub_billings"),
        F.when(full, F.col("w").cast("double")).alias("pub_write_offs"),
        F.when(F.col("has_q4"), F.col("rb_ye").cast("double")).alias("pub_rollover_ye"),
        F.when(F.col("has_q4"), F.col("p_ye").cast("double")).alias("pub_principal_ye"),
        F.when(full, F.round(F.try_divide(F.col("w").cast("double") * 100, F.col("rb").cast("double") / 4), 1)).alias("pub_rate_pct"))


def raw_annual(spark: SparkSession, sf_dir: str, keys: Sequence[str]) -> DataFrame:
    """Independent recompute for the hand check: per complete year, the loss
    and the average balance straight from the facts."""
    agg = year_facts(spark, sf_dir, keys).where(F.col("nq") == 4)
    return agg.select(*keys, "year", F.col("w").cast("double").alias("raw_w"),
                      (F.col("rb").cast("double") / 4).alias("raw_r"))


def events_panel(spark: SparkSession, sf_dir: str, keys: Sequence[str] = ("event_type",)) -> DataFrame:
    """Daily panel of the event stream: events (flow), value (flow),
    distinct users (stock)."""
    ev = read_table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    panel = build_panel(ev, keys, F.to_date("ts"),
                        {"events": F.count(F.lit(1)), "value": F.sum(money("value")),
                         "users": F.countDistinct("user_id")})
    return cluster_by_entity(panel, keys)
