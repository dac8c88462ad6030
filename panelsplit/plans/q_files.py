"""Rows-only queries that write files: landing-file checks with a manifest,
the gated write of the validated panel and bridge, and the reproducibility
hash. They write under the shared folder named by ``spark.checkpoint.dir``
(a fresh sub-folder per run) and return small result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import plain_text
from ..operators import checks as K
from ..operators import decompose as D
from ..operators import landing as L
from ..operators import reshape as RS
from ..operators.profile import table_hash
from ..session import cut_lineage, scratch_path
from ..functions.periods import quarter_start
from ..sources import files as FS
from ..sources.tables import read_table
from ..streaming.panel_stream import incremental_panel, refresh_to_table
from . import facts as FX
from . import sqlparts as S
from .edge import finish, sql_finish
from .q_core import bridge_yearly, panel_quarterly
from .q_decompose import sensitivity_table
from .registry import SEG, register
from .registry import with_ctes as _with

_MEASURES = ["principal", "supplementary", "billings", "rollover", "write_offs", "rate_pct"]
_PUB_SERIES = {"billings": "pub_billings", "write_offs": "pub_write_offs", "rollover": "pub_rollover_ye",
               "principal": "pub_principal_ye", "rate_pct": "pub_rate_pct"}


def _newest_first(wide, ids):
    labels = sorted([c for c in wide.columns if c not in ids], reverse=True)
    return wide.select(*ids, *labels)


_CLEAN_CHECKS = ("first column is the id", "malformed labels", "duplicate labels", "labels contiguous", "coverage floor", "row width",
                 "numeric cells", "expected series")


def _landing_sql() -> str:
    names = ", ".join(f"('{c}')" for c in _CLEAN_CHECKS)
    return _with(S.panel_cte(SEG), f"ranked AS (SELECT {SEG[0]} AS k, row_number() OVER (ORDER BY {SEG[0]}) AS rk FROM (SELECT DISTINCT {SEG[0]} FROM panel))",
                 f"checks AS (SELECT * FROM (VALUES {names}) AS t(check_name))") + f"""
SELECT sub || '/{SEG[0]}=' || k AS path, check_name, CAST(0 AS BIGINT) AS violations
FROM ranked, (VALUES ('quarterly'), ('annual')) AS s(sub), (SELECT * FROM checks UNION ALL SELECT 'manifest hash') AS c
UNION ALL SELECT 'segment=' || k, c, 0 FROM ranked, (VALUES ('restaged cells'), ('annual round trip')) AS t(c)
UNION ALL
SELECT 'damaged/{SEG[0]}=' || k, check_name, CASE WHEN check_name = 'malformed labels' THEN 1 WHEN check_name = 'numeric cells' AND rk = 1 THEN 1
  WHEN check_name = 'expected series' THEN CASE rk WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END ELSE 0 END
FROM ranked, checks"""


def _damage(wide):
    """A malformed label for all; by rank of the segment a cell that is no number, a series with another name, a series
    that is there twice, a name with quotes and a line end."""
    labels = [c for c in wide.columns if c not in (*SEG, "series")]
    out = wide.withColumn("_rk", F.dense_rank().over(Window.orderBy(SEG[0])))
    out = out.withColumns({
        labels[0]: F.when((F.col("_rk") == 1) & (F.col("series") == "billings"), F.lit("x1")).otherwise(F.col(f"`{labels[0]}`")),
        "series": F.when((F.col("_rk") == 2) & (F.col("series") == "rollover"), F.lit("rolling"))
        .when((F.col("_rk") == 4) & (F.col("series") == "rollover"), F.lit('the "net"\nrollover, all')).otherwise(F.col("series"))})
    out = out.unionByName(out.where((F.col("_rk") == 3) & (F.col("series") == "rollover")))
    return out.drop("_rk").withColumnRenamed(labels[-1], labels[-1].replace("Q", "XQ"))


@register("landing_checks", sql=_landing_sql())
def landing_checks(spark, sf_dir):
    """Write the segment panel as wide quarterly files and the published
    table as wide annual files ('na' = missing), then check every landed file:
    header (id column, malformed/duplicate labels, contiguity, coverage), rows
    (width, numeric cells, series multiset), manifest (bytes/sha256 recorded,
    re-read and compared) and re-staging (cells staged from the files equal
    the panel's cells)."""
    base = scratch_path(spark, f"landing-{uuid.uuid4().hex}")
    panel = cut_lineage(FX.fact_panel(spark, sf_dir, SEG))       # pivot + re-staging reuse it
    q_wide = RS.pivot_wide(RS.panel_to_long(panel, SEG, {m: m for m in _MEASURES}), SEG)
    q_wide = cut_lineage(_newest_first(q_wide, [*SEG, "series"]))
    FS.write_wide(q_wide, f"{base}/quarterly", SEG[0])
    FS.write_wide(_damage(q_wide), f"{base}/damaged", SEG[0])
    pub = FX.published_annual(panel, SEG)
    a_long = (pub.select(*SEG, F.col("year").cast("string").alias("label"),
                         *[plain_text(c).alias(s) for s, c in _PUB_SERIES.items()])
              .unpivot([*SEG, "label"], list(_PUB_SERIES), "series", "value"))
    FS.write_wide(_newest_first(RS.pivot_wide(a_long, SEG), [*SEG, "series"]), f"{base}/annual", SEG[0], "na")

    out = []
    for kind, sub, series, allow_na, floor in ((L.QUARTER, "quarterly", _MEASURES, False, 20),
                                               (L.YEAR, "annual", list(_PUB_SERIES), True, 5)):
        glob = f"{base}/{sub}/*/*.csv"
        out.append(L.file_checks(spark, glob, "series", kind, series, allow_na, floor))
        prof = L.profile_files(spark, glob, kind)
        prof.write.mode("overwrite").json(f"{base}/manifest/{sub}")
        recorded = spark.read.json(f"{base}/manifest/{sub}")
        out.append(L.manifest_mismatches(FS.file_hashes(spark, glob), recorded))

    out.append(L.file_checks(spark, f"{base}/damaged/*/*.csv", "series", L.QUARTER, _MEASURES, False, 20))
    restaged = RS.stage_wide(FS.read_wide(spark, f"{base}/quarterly").drop("source_file"), SEG,
                             {m: m for m in _MEASURES})
    cells = lambda df: df.groupBy(*SEG).agg(
        sum(F.count(m) for m in _MEASURES).alias("n"))
    diff = (cells(restaged).join(cells(panel).withColumnRenamed("n", "m"), SEG, "full_outer")
            .select(F.concat(F.lit("segment="), F.col(SEG[0])).alias("path"),
                    F.lit("restaged cells").alias("check_name"),
                    F.when(F.col("n").eqNullSafe(F.col("m")), 0).otherwise(1).cast("bigint").alias("violations")))
    out.append(diff)
    # annual files read back ('na' -> NULL) must reproduce the published values
    back = FS.read_annual_long(spark, f"{base}/annual", "series", extra_ids=SEG)
    pub_long = (pub.select(*SEG, "year", *[F.col(c).alias(s) for s, c in _PUB_SERIES.items()])
                .unpivot([*SEG, "year"], list(_PUB_SERIES), "series", "pub"))
    trip = (back.join(pub_long, [*SEG, "series", "year"], "full_outer")
            .groupBy(*SEG).agg(F.count_if(~F.col("value").eqNullSafe(F.col("pub"))).alias("violations"))
            .select(F.concat(F.lit("segment="), F.col(SEG[0])).alias("path"),
                    F.lit("annual round trip").alias("check_name"), F.col("violations").cast("bigint")))
    out.append(trip)
    res = out[0]
    for d in out[1:]:
        res = res.unionByName(d)
    return res.withColumn("path", F.regexp_replace("path", r"^.*?/(quarterly|annual|damaged)/([^/]*)/.*$", "$1/$2"))


@register("gated_write", sql=_with(S.panel_cte(SEG), S.annual_cte(SEG)) + f"""
SELECT 'panel' AS "table", count(*) AS rows, TRUE AS has_key, count(*) > 0 AS ok FROM panel
UNION ALL
SELECT 'bridge', count(*), TRUE, count(*) > 0
FROM (SELECT year, lag(year) OVER (PARTITION BY {SEG[0]} ORDER BY year) AS py FROM annual) AS a WHERE year = py + 1""")
def gated_write(spark, sf_dir):
    """Checks -> gate -> write: the panel (counts narrowed to BIGINT only
    after the whole-number check passed) as Parquet partitioned by year, the
    bridge as CSV in a fixed column order; both read back and checked
    (non-empty, key column present). Nothing is written when a check fails.
    The panel feeds the checks, the bridge and the write, so it is
    checkpointed once into the shared folder (lineage cut, reused 3x)."""
    panel = cut_lineage(FX.fact_panel(spark, sf_dir, SEG))
    K.gate(K.quality_checks(panel, SEG, floor="1995-01-01", as_of="2001-12-31", min_periods=20, highest_rate=100),
           "panel checks")
    bridge = D.yearly_bridge(panel, SEG, FX.published_annual(panel, SEG))
    K.gate(K.closure_violations(bridge, SEG), "bridge closure")
    out = scratch_path(spark, f"published-{uuid.uuid4().hex}")
    (panel.withColumns({"principal": F.col("principal").cast("bigint"),
                        "supplementary": F.col("supplementary").cast("bigint"),
                        "year": F.year("period")})
     .write.mode("overwrite").partitionBy("year").parquet(f"{out}/panel"))
    cols = ["c_mktsegment", "year", "previous_year", "write_offs", "avg_rollover", "rate_pct",
            "rate_pct_pub_annual", "delta_write_offs", "volume", "rate", "interaction", "check",
            "annual_crosscheck_status"]
    # result file in key order (range-partitioned sort: the only ORDER BY, at the output edge)
    (bridge.select(*cols).orderBy("c_mktsegment", "year")
     .write.mode("overwrite").option("header", True).csv(f"{out}/bridge"))
    back_p = spark.read.parquet(f"{out}/panel")
    back_b = spark.read.option("header", True).csv(f"{out}/bridge")
    res = []
    for name, df, key in (("panel", back_p, "period"), ("bridge", back_b, "year")):
        res.append(df.agg(F.count(F.lit(1)).alias("rows"))
                   .select(F.lit(name).alias("table"), "rows", F.lit(key in df.columns).alias("has_key"))
                   .withColumn("ok", (F.col("rows") > 0) & F.col("has_key")))
    return res[0].unionByName(res[1])


@register("table_hash")
def table_hash_query(spark, sf_dir):
    """Content hash of three result tables, computed twice in independent
    executions; ``reproducible`` when both runs agree. An execution reads the
    facts once: its tables come from one panel, which is not the other's."""
    tables = {"panel_quarterly": panel_quarterly, "bridge_yearly": bridge_yearly, "sensitivity": sensitivity_table}
    runs = []
    for _ in range(2):
        panel = FX.fact_panel(spark, sf_dir, SEG, materialize=True)
        runs.append({n: table_hash(finish(q(spark, sf_dir, panel))) for n, q in tables.items()})
    first = {n: h.collect()[0] for n, h in runs[0].items()}
    res = None
    for n, h in runs[1].items():
        h = h.select(F.lit(n).alias("table"), "rows", "content_hash",
                     ((F.col("content_hash") == F.lit(first[n]["content_hash"]))
                      & (F.col("rows") == F.lit(first[n]["rows"]))).alias("reproducible"))
        res = h if res is None else res.unionByName(h)
    return res


@register("panel_stream", sql=sql_finish(_with(S.panel_cte(SEG)) + """
SELECT c_mktsegment, period, CAST(billings AS DOUBLE) AS billings, CAST(rollover AS DOUBLE) AS rollover,
  CAST(write_offs AS DOUBLE) AS write_offs FROM panel""", keep=["c_mktsegment", "period"]))
def panel_stream(spark, sf_dir):
    """Incremental refresh: the line files are consumed as a stream (one file
    per trigger), joined to the static orders and customers, the additive
    measures aggregated per (segment, quarter), the changed cells appended batch by
    batch; the cells as last left must equal the batch panel's flows."""
    li_schema = read_table(spark, sf_dir, "lineitem").schema
    lines = (spark.readStream.schema(li_schema).option("pathGlobFilter", "lineitem.parquet")
             .option("maxFilesPerTrigger", 1).parquet(sf_dir).select(*FX.LINE_COLS))
    orders = read_table(spark, sf_dir, "orders").select(*FX.ORDER_COLS)
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", *SEG)
    facts = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(customer, F.col("o_custkey") == F.col("c_custkey")))
    sdf = incremental_panel(facts, SEG, quarter_start("o_orderdate"), {
        "billings": ("sum", FX.line_amount()),
        "rollover": ("sum", F.when(F.col("l_linestatus") == "O", FX.line_amount())),
        "write_offs": ("sum", F.when(F.col("l_returnflag") == "R", FX.loss_amount()))})
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    out = refresh_to_table(sdf, f"{base}/panel", f"{base}/checkpoint", [*SEG, "period"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("billings", "rollover", "write_offs")})
