"""SQL building blocks for the oracle queries (DuckDB dialect).

These mirror the Spark plans definition by definition so a registered query and
its oracle compute the same numbers in the same arithmetic order.
"""

from __future__ import annotations


def panel_cte(keys: list[str], name: str = "panel") -> str:
    k = ", ".join(keys)
    join_c = any(x.startswith("c_") and x != "c_custkey" for x in keys)
    cust = " JOIN customer ON o_custkey = c_custkey" if join_c else ""
    return f"""{name}_raw AS (
  SELECT {k}, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period,
    count(DISTINCT o_custkey) AS principal,
    count(DISTINCT l_suppkey) AS supplementary,
    sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS billings,
    sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS rollover,
    sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2))
             * (1 - CAST(l_discount AS DECIMAL(4,2))) END) AS write_offs
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey{cust}
  GROUP BY ALL),
{name} AS (
  SELECT *, round(CAST(write_offs AS DOUBLE) * 100 / CAST(billings AS DOUBLE), 1) AS rate_pct
  FROM {name}_raw)"""


def annual_cte(keys: list[str], panel: str = "panel", name: str = "annual") -> str:
    k = ", ".join(keys)
    return f"""{name} AS (
  SELECT {k}, CAST(year(period) AS BIGINT) AS year, count(*) AS quarters,
    CASE WHEN count(write_offs) = 4 THEN CAST(sum(write_offs) AS DOUBLE) END AS write_offs,
    CASE WHEN count(rollover) = 4 THEN CAST(sum(rollover) AS DOUBLE) / count(*) END AS avg_rollover,
    CASE WHEN count(billings) = 4 THEN CAST(sum(billings) AS DOUBLE) END AS billings,
    CASE WHEN count(rate_pct) = 4 THEN CAST(sum(rate_pct) AS DOUBLE) / count(*) END AS rate_pct_avg_quarterly,
    CASE WHEN count(write_offs) = 4 AND count(rollover) = 4
         THEN 100.0 * CAST(sum(write_offs) AS DOUBLE) / (CAST(sum(rollover) AS DOUBLE) / count(*)) END
      AS rate_pct_recomputed
  FROM {panel} GROUP BY ALL HAVING count(*) = 4)"""


def published_cte(keys: list[str], name: str = "published") -> str:
    k = ", ".join(keys)
    join_c = any(x.startswith("c_") and x != "c_custkey" for x in keys)
    cust = " JOIN customer ON o_custkey = c_custkey" if join_c else ""
    return f"""{name}_raw AS (
  SELECT {k}, CAST(year(o_orderdate) AS BIGINT) AS year,
    count(DISTINCT quarter(o_orderdate)) AS nq,
    sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS b,
    sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2))
             * (1 - CAST(l_discount AS DECIMAL(4,2))) END) AS w,
    sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS rb,
    sum(CASE WHEN quarter(o_orderdate) = 4 AND l_linestatus = 'O'
             THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS rb_ye,
    count(DISTINCT CASE WHEN quarter(o_orderdate) = 4 THEN o_custkey END) AS p_ye,
    bool_or(quarter(o_orderdate) = 4) AS has_q4
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey{cust}
  GROUP BY ALL),
{name} AS (
  SELECT {k}, year,
    CASE WHEN nq = 4 THEN CAST(b AS DOUBLE) END AS pub_billings,
    CASE WHEN nq = 4 THEN CAST(w AS DOUBLE) END AS pub_write_offs,
    CASE WHEN has_q4 THEN CAST(rb_ye AS DOUBLE) END AS pub_rollover_ye,
    CASE WHEN has_q4 THEN CAST(p_ye AS DOUBLE) END AS pub_principal_ye,
    CASE WHEN nq = 4 THEN round(CAST(w AS DOUBLE) * 100 / (CAST(rb AS DOUBLE) / 4), 1) END AS pub_rate_pct
  FROM {name}_raw)"""


def bridge_exprs(w0: str, R0: str, w1: str, R1: str) -> str:
    """Midpoint + base-weighted split as SELECT list items over a row carrying
    both periods (names: r0, r1, dW, dR, dr, volume, rate, inter, ...)."""
    return f"""{w0} / {R0} AS ratio0, {w1} / {R1} AS ratio1, {w1} - {w0} AS d_w, {R1} - {R0} AS d_base"""


def bridge_select(w0: str, R0: str, w1: str, R1: str, src: str) -> str:
    """Three nested SELECTs computing the split in the same order as Spark."""
    return f"""(SELECT *,
      CASE WHEN abs(d_w - volume - rate) <= 1e-12 * greatest(1.0, abs(d_w), abs(volume), abs(rate))
           THEN 0.0 ELSE d_w - volume - rate END AS inter
    FROM (SELECT *, d_base * (ratio0 + ratio1) / 2 AS volume, d_ratio * ({R0} + {R1}) / 2 AS rate,
                 d_base * ratio0 AS volume_b, d_ratio * {R0} AS rate_b, d_base * d_ratio AS inter_b
          FROM (SELECT *, ratio1 - ratio0 AS d_ratio
                FROM (SELECT *, {bridge_exprs(w0, R0, w1, R1)} FROM {src}) AS _b1) AS _b2) AS _b3)"""


def closes_expr() -> str:
    return ("(abs(volume + rate + inter - d_w) <= 1e-9 * greatest(1.0, abs(d_w)) "
            "AND abs(inter) <= 1e-9 * greatest(1.0, abs(d_w)))")


def pairs_cte(keys: list[str], src: str, cols: list[str], name: str = "pairs") -> str:
    """Consecutive-year pairs by lag (suffix 0 on the previous year's columns)."""
    k = ", ".join(keys)
    lags = ", ".join(f"lag({c}) OVER w AS {c}0" for c in ["year", *cols])
    return f"""{name} AS (
  SELECT * FROM (SELECT *, {lags} FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY year)) AS _p
  WHERE year = year0 + 1)"""


def inline_bridge(w0: str, R0: str, w1: str, R1: str) -> dict[str, str]:
    """Bridge terms as self-contained expressions (same operation order as
    ``add_bridge``)."""
    r0, r1 = f"({w0} / {R0})", f"({w1} / {R1})"
    d_w, d_base, d_ratio = f"({w1} - {w0})", f"({R1} - {R0})", f"({r1} - {r0})"
    volume = f"({d_base} * ({r0} + {r1}) / 2)"
    rate = f"({d_ratio} * ({R0} + {R1}) / 2)"
    raw = f"({d_w} - {volume} - {rate})"
    inter = (f"(CASE WHEN abs({raw}) <= 1e-12 * greatest(1.0, abs({d_w}), abs({volume}), abs({rate})) "
             f"THEN 0.0 ELSE {raw} END)")
    eps = f"(1e-9 * greatest(1.0, abs({d_w})))"
    closes = f"(abs({volume} + {rate} + {inter} - {d_w}) <= {eps} AND abs({inter}) <= {eps})"
    return {"d_w": d_w, "d_base": d_base, "d_ratio": d_ratio, "volume": volume, "rate": rate,
            "inter": inter, "closes": closes, "volume_b": f"({d_base} * {r0})",
            "rate_b": f"({d_ratio} * {R0})", "inter_b": f"({d_base} * {d_ratio})"}
