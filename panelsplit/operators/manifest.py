"""Manifests of landed files: nested entries, their history over runs, and what changed.

An entry describes one file: a name that stays the same over runs, and a struct of its size, hash, coverage and
series. The history is append-only: every run adds its entries, and a mark for each file that is gone, so the latest
entry of a name tells how it was last seen. Comparing two states is a full outer join on the name; a file that is new
under one name and gone under another with the same content has moved.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import label_of_index
from .landing import QUARTER

INFO = ("struct<dataset:string,bytes:bigint,sha256:string,rows:bigint,labels:bigint,label_min:string,"
        "label_max:string,series:array<string>>")
_HISTORY = f"run bigint, name string, gone boolean, info {INFO}"
_DOCUMENT = f"source string, retrieved_at string, files map<string,{INFO}>"


def entries(profile: DataFrame, name: Column, dataset: Column, kind: str) -> DataFrame:
    """(name, info) of ``landing.profile_files`` rows."""
    shown = label_of_index if kind == QUARTER else (lambda c: F.col(c).cast("string"))
    info = F.struct(
        dataset.alias("dataset"), F.col("bytes").cast("bigint").alias("bytes"), "sha256", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
        F.col("labels").cast("bigint").alias("labels"), shown("label_min_idx").alias("label_min"), shown("label_max_idx").alias("label_max"),
        F.coalesce("series", F.array().cast("array<string>")).alias("series"))
    return profile.select(name.alias("name"), info.cast(INFO).alias("info"))


# ------------------------------------------------------------------ nested documents

def write_documents(entries_of: DataFrame, group: Column, source: str, retrieved_at: str, path: str) -> None:
    """One JSON document a group (such as an entity, which has a file for each dataset) with a map from file to entry."""
    files = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "info"))))
    doc = F.to_json(F.struct(F.lit(source).alias("source"), F.lit(retrieved_at).alias("retrieved_at"), files.alias("files")))
    entries_of.groupBy(group.alias("_group")).agg(doc.alias("value")).select("value").write.mode("errorifexists").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, retrieved_at, files): the documents parsed into a map of structs. A line that is no such document
    fails the read."""
    doc = F.from_json("value", f"struct<{_DOCUMENT.replace(' string', ':string').replace('files map', 'files:map')}>", {"mode": "FAILFAST"})
    return spark.read.text(path).where(F.trim("value") != "").select(doc.alias("d")).select("d.*")


# ------------------------------------------------------------------ history

def history(spark: SparkSession, table: str) -> DataFrame:
    """All entries ever recorded: (run, name, gone, info)."""
    try:
        return spark.read.schema(_HISTORY).json(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _HISTORY)


def last_seen(recorded: DataFrame, before_run: int | None = None) -> DataFrame:
    """(name, info) of the files there after the runs before ``before_run``: one aggregate over the history."""
    rows = recorded if before_run is None else recorded.where(F.col("run") < before_run)
    latest = rows.groupBy("name").agg(F.max_by(F.struct("gone", "info"), F.col("run")).alias("e"))
    return latest.where(~F.col("e.gone")).select("name", "e.info")


def compare(now: DataFrame, earlier: DataFrame) -> DataFrame:
    """(name, status, moved_from, sha256_before, sha256_now): status is unchanged, changed, added, removed or moved.

    A moved file stands under its new name; of several files with the same content that went, the first name counts,
    and the others are removed."""
    j = (now.select("name", F.col("info.sha256").alias("sha256_now"))
         .join(earlier.select("name", F.col("info.sha256").alias("sha256_before")), "name", "full_outer"))
    j = j.withColumn("status", F.when(F.col("sha256_before").isNull(), "added").when(F.col("sha256_now").isNull(), "removed")
                     .when(F.col("sha256_now") == F.col("sha256_before"), "unchanged").otherwise("changed"))
    ends = (j.where(F.col("status").isin("added", "removed")).groupBy(F.coalesce("sha256_now", "sha256_before").alias("sha"))
            .agg(F.min(F.when(F.col("status") == "added", F.col("name"))).alias("to"), F.min(F.when(F.col("status") == "removed", F.col("name"))).alias("from"))
            .where(F.col("to").isNotNull() & F.col("from").isNotNull()))
    moved = j.join(ends, (F.coalesce("sha256_now", "sha256_before") == F.col("sha")) & F.col("status").isin("added", "removed"), "left")
    came, went = F.col("name").eqNullSafe(F.col("to")), F.col("name").eqNullSafe(F.col("from"))
    return moved.where(~went).select(
        "name", F.when(came, "moved").otherwise(F.col("status")).alias("status"), F.when(came, F.col("from")).alias("moved_from"), "sha256_before", "sha256_now")


def record(now: DataFrame, table: str) -> DataFrame:
    """Compare ``now`` (name, info) with the files last seen in the history, append this run, and return the comparison
    with the run's number."""
    spark = now.sparkSession
    recorded = history(spark, table)
    run = (recorded.agg(F.max("run")).collect()[0][0] or 0) + 1
    earlier = last_seen(recorded, run)
    gone = earlier.join(now, "name", "left_anti").select("name", F.lit(True).alias("gone"), F.lit(None).cast(INFO).alias("info"))
    rows = now.select("name", F.lit(False).alias("gone"), "info").unionByName(gone)
    rows.select(F.lit(run).cast("bigint").alias("run"), "name", "gone", "info").write.mode("append").json(table)
    recorded = history(spark, table)
    here = recorded.where((F.col("run") == run) & ~F.col("gone")).select("name", "info")
    return compare(here, last_seen(recorded, run)).withColumn("run", F.lit(run).cast("bigint"))
