"""Manifests of landed files and the all-or-nothing publication, run on files derived from the order book.

The queries write under the shared folder named by ``spark.checkpoint.dir`` (a fresh sub-folder a run), read everything
back, and return what a reader sees; the oracle says the same from the tables alone.
"""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.numeric import plain_text
from ..operators import checks as K
from ..operators import decompose as D
from ..operators import landing as L
from ..operators import manifest as MF
from ..operators import publish as PB
from ..operators import reshape as RS
from ..session import cut_lineage, scratch_path
from ..sources import files as FS
from . import facts as FX
from . import sqlparts as S
from .q_files import _MEASURES, _PUB_SERIES, _newest_first
from .registry import SEG, register
from .registry import with_ctes as _with

_K = SEG[0]
_SEGP = S.panel_cte(SEG)


def _entity() -> Column:
    return F.regexp_extract("path", f"{_K}=([^/]*)/", 1)


def _profile(spark, folder, kind):
    return L.profile_files(spark, f"{folder}/*/*.csv", kind)


def _quarterly(panel):
    return _newest_first(RS.pivot_wide(RS.panel_to_long(panel, SEG, {m: m for m in _MEASURES}), SEG), [*SEG, "series"])


def _annual(panel):
    pub = FX.published_annual(panel, SEG)
    long = (pub.select(*SEG, F.col("year").cast("string").alias("label"), *[plain_text(c).alias(s) for s, c in _PUB_SERIES.items()])
            .unpivot([*SEG, "label"], list(_PUB_SERIES), "series", "value"))
    return _newest_first(RS.pivot_wide(long, SEG), [*SEG, "series"])


@register("manifest_documents", sql=_with(_SEGP, f"""files AS (
  SELECT 'quarterly' AS dataset, (SELECT list_sort([{", ".join(f"'{m}'" for m in _MEASURES)}])) AS series, count(DISTINCT period) AS labels,
    min(CAST(year(period) AS VARCHAR) || ' Q' || quarter(period)) AS label_min,
    max(CAST(year(period) AS VARCHAR) || ' Q' || quarter(period)) AS label_max FROM panel
  UNION ALL
  SELECT 'annual', (SELECT list_sort([{", ".join(f"'{m}'" for m in _PUB_SERIES)}])), count(DISTINCT year(period)),
    CAST(min(year(period)) AS VARCHAR), CAST(max(year(period)) AS VARCHAR) FROM panel)""") + f"""
SELECT DISTINCT {_K}, dataset, 'order book' AS source, CAST(2 AS BIGINT) AS files, CAST(len(series) AS BIGINT) AS n_rows, labels, label_min, label_max,
  series[1] AS first_series, array_to_string(series, ',') AS all_series
FROM panel, files""")
def manifest_documents(spark, sf_dir):
    """A manifest document a segment: landed quarterly and annual files, each with its series names and period
    labels, written as nested JSON and read back by field access."""
    base = scratch_path(spark, f"manifest-{uuid.uuid4().hex}")
    panel = cut_lineage(FX.fact_panel(spark, sf_dir, SEG))
    FS.write_wide(_quarterly(panel), f"{base}/quarterly", _K)
    FS.write_wide(_annual(panel), f"{base}/annual", _K, "na")
    found = None
    for dataset, kind in (("quarterly", L.QUARTER), ("annual", L.YEAR)):
        of = MF.entries(_profile(spark, f"{base}/{dataset}", kind), F.concat(_entity(), F.lit(f"/{dataset}.csv")), F.lit(dataset), kind)
        found = of if found is None else found.unionByName(of)
    MF.write_documents(found, F.substring_index("name", "/", 1), "order book", "1998-12-31", f"{base}/documents")
    docs = MF.read_documents(spark, f"{base}/documents")
    out = None
    for dataset in ("quarterly", "annual"):
        # One file of each document, by its key in the map.
        key = F.filter(F.map_keys("files"), lambda n: n.endswith(f"/{dataset}.csv"))[0]
        info = F.col("files")[key]
        rows = docs.select(
            F.substring_index(key, "/", 1).alias(_K), info["dataset"].alias("dataset"), "source", F.size("files").cast("bigint").alias("files"),
            info["rows"].alias("n_rows"), info["labels"].alias("labels"), info["label_min"].alias("label_min"), info["label_max"].alias("label_max"),
            info["series"][0].alias("first_series"), F.array_join(info["series"], ",").alias("all_series"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("manifest_history", sql=_with(_SEGP, f"ranked AS (SELECT {_K}, row_number() OVER (ORDER BY {_K}) AS rk FROM (SELECT DISTINCT {_K} FROM panel))") + f"""
SELECT run, name, status, moved_from, status IN ('unchanged', 'changed') AS seen_before FROM (
  SELECT CAST(1 AS BIGINT) AS run, {_K} AS name, 'added' AS status, CAST(NULL AS VARCHAR) AS moved_from FROM ranked
  UNION ALL SELECT 2, {_K}, CASE rk WHEN 1 THEN 'changed' WHEN 2 THEN 'removed' ELSE 'unchanged' END, NULL FROM ranked WHERE rk <> 4
  UNION ALL SELECT 2, 'copy:' || {_K}, 'added', NULL FROM ranked WHERE rk = 3
  UNION ALL SELECT 2, 'new:' || {_K}, 'moved', {_K} FROM ranked WHERE rk = 4
  UNION ALL SELECT 3, {_K}, CASE WHEN rk = 2 THEN 'added' ELSE 'unchanged' END, NULL FROM ranked WHERE rk <> 4
  UNION ALL SELECT 3, 'copy:' || {_K}, 'removed', NULL FROM ranked WHERE rk = 3
  UNION ALL SELECT 3, 'new:' || {_K}, 'unchanged', NULL FROM ranked WHERE rk = 4) AS x""")
def manifest_history(spark, sf_dir):
    """Three landings of the segments' files against the append-only manifest. In the second, one file is changed in
    one cell, one is gone, one is there twice, one has another name; the third brings the gone one back and drops
    the second copy. Every run is compared with the files as last seen."""
    base = scratch_path(spark, f"history-{uuid.uuid4().hex}")
    panel = cut_lineage(FX.fact_panel(spark, sf_dir, SEG))
    rank = F.dense_rank().over(Window.orderBy(_K))  # over the segments' wide rows only
    wide = cut_lineage(_quarterly(panel).withColumn("_rk", rank))
    newest = next(c for c in wide.columns if c not in (*SEG, "series", "_rk"))
    tampered = F.when((F.col("_rk") == 1) & (F.col("series") == "billings"), F.lit("1")).otherwise(F.col(f"`{newest}`"))
    second = wide.where("_rk <> 2").withColumns({newest: tampered, _K: F.when(F.col("_rk") == 4, F.concat(F.lit("new:"), _K)).otherwise(F.col(_K))})
    third = second.unionByName(wide.where("_rk = 2"))
    second = second.unionByName(wide.where("_rk = 3").withColumn(_K, F.concat(F.lit("copy:"), _K)))
    out = None
    for run, landed in enumerate((wide, second, third)):
        FS.write_wide(landed.drop("_rk"), f"{base}/landing-{run}", _K)
        name = F.replace(_entity(), F.lit("%3A"), F.lit(":"))  # the folder's name has the colon escaped
        now = MF.entries(_profile(spark, f"{base}/landing-{run}", L.QUARTER), name, F.lit("quarterly"), L.QUARTER)
        changes = cut_lineage(MF.record(now, f"{base}/manifest"))
        out = changes if out is None else out.unionByName(changes)
    return out.select("run", "name", "status", "moved_from", (F.col("sha256_before").isNotNull() & F.col("sha256_now").isNotNull()).alias("seen_before"))


_SWAP_STATES = "(VALUES ('first run', 0), ('after a failing check', 0), ('after a broken write', 0), ('second run', 1995))"


@register("published_swap", sql=_with(_SEGP, S.annual_cte(SEG), f"states AS (SELECT * FROM {_SWAP_STATES} AS t(state, since))") + f"""
SELECT state, 'panel' AS output, count(*) AS n, CAST(sum(billings) AS DOUBLE) AS total
FROM panel, states WHERE year(period) >= since GROUP BY state
UNION ALL
SELECT state, 'bridge', count(*), CAST(sum(year) AS DOUBLE)
FROM (SELECT *, lag(year) OVER (PARTITION BY {_K} ORDER BY year) AS py FROM annual) AS a, states
WHERE year = py + 1 AND py >= since GROUP BY state""")
def published_swap(spark, sf_dir):
    """What a reader sees of a published pair (panel and bridge): after a first run, after a run whose checks fail,
    after one whose second output breaks off while it is written, and after a second complete run (1995 on)."""
    root = scratch_path(spark, f"swap-{uuid.uuid4().hex}")
    panel = cut_lineage(FX.fact_panel(spark, sf_dir, SEG))

    def pair(p, breaks=False):
        bridge = D.yearly_bridge(p, SEG, FX.published_annual(p, SEG)).select(*SEG, "year", "volume", "rate", "interaction", "closes")
        checks = {"panel checks": K.quality_checks(p, SEG, floor="1992-01-01", as_of="2001-12-31", min_periods=12, highest_rate=100),
                  "bridge closure": K.closure_violations(bridge, SEG)}
        if breaks:
            bridge = bridge.withColumn("rate", F.when(F.col("year") > 0, F.raise_error(F.lit("disk full")).cast("double")))
        return {"panel": PB.Output(p.withColumn("year", F.year("period")), partition_by=("year",)),
                "bridge": PB.Output(bridge.orderBy(*SEG, "year"), "csv", options={"header": "true"})}, checks

    def seen(state):
        p, b = PB.published(spark, root, "panel"), PB.published(spark, root, "bridge", header="true")
        return (p.select(F.lit(state).alias("state"), F.lit("panel").alias("output"), F.col("billings").cast("decimal(30,4)").alias("v"))
                .unionByName(b.select(F.lit(state).alias("state"), F.lit("bridge").alias("output"), F.col("year").cast("decimal(30,4)").alias("v")))
                .groupBy("state", "output").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")))

    PB.publish(spark, root, *pair(panel))
    out = seen("first run")
    try:
        PB.publish(spark, root, *pair(panel.withColumn("billings", -F.col("billings"))))
    except K.GateError:
        out = out.unionByName(seen("after a failing check"))
    try:
        PB.publish(spark, root, *pair(panel.where(F.year("period") >= 1994), breaks=True))
    except PySparkException:
        out = out.unionByName(seen("after a broken write"))
    PB.publish(spark, root, *pair(panel.where(F.year("period") >= 1995)))
    return out.unionByName(seen("second run"))
