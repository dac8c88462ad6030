"""Structural checks of landed wide files, per file, as one job over many files.

Checks work on the records as they are written; they are array expressions and
aggregates keyed by file path (no driver loop over files, no file as one row).
Results are long rows ``(path, check_name, violations)``; ``profile_files`` is
the manifest of each file (bytes, sha256, rows, label count and range, series).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import NUMERIC_TEXT_PATTERN, QUARTER_LABEL_PATTERN, YEAR_LABEL_PATTERN
from ..sources.files import csv_fields, csv_records, file_hashes, file_list

QUARTER, YEAR = "quarter", "year"


def _label_index(kind: str):
    if kind == QUARTER:
        return lambda x: F.substring(x, 1, 4).try_cast("int") * 4 + F.substring(x, 5, 1).try_cast("int")
    return lambda x: x.try_cast("int")


def _header_violations(fields: Column, id_col: str, kind: str, min_labels: int, oldest_latest: int | None) -> dict[str, Column]:
    """First column, malformed labels, duplicate labels, label contiguity (sorted index steps of 1), the coverage floor
    and, with a floor for it, how recent the latest label is."""
    pattern = QUARTER_LABEL_PATTERN if kind == QUARTER else YEAR_LABEL_PATTERN
    labels = F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(1)))
    good = F.filter(labels, lambda x: x.rlike(pattern))
    # distinct: a repeated label is reported by the duplicate check only
    index = F.array_sort(F.array_distinct(F.transform(good, _label_index(kind))))
    rest = F.greatest(F.size(index) - 1, F.lit(1))
    steps = F.zip_with(F.slice(index, 2, rest), F.slice(index, 1, rest), lambda a, b: a - b)
    checks = {
        "first column is the id": F.when(F.get(fields, F.lit(0)) == id_col, 0).otherwise(1),
        "malformed labels": F.size(labels) - F.size(good),
        "duplicate labels": F.size(labels) - F.size(F.array_distinct(labels)),
        "labels contiguous": F.when(F.size(index) > 1, F.size(F.filter(steps, lambda d: d != 1))).otherwise(0),
        "coverage floor": F.when(F.size(F.array_distinct(good)) >= min_labels, 0).otherwise(1),
    }
    if oldest_latest is not None:
        checks["latest label is recent"] = F.when(F.array_max(index) >= oldest_latest, 0).otherwise(1)
    return checks


def file_checks(spark: SparkSession, glob: str, id_col: str, kind: str, expected_series: Sequence[str], allow_na: bool,
                min_labels: int, as_of: _dt.date | None = None, lag: int = 2) -> DataFrame:
    """All structural checks of every file, from one read of the records: (path, check_name, violations).

    Rows are counted by (file, series, width), then by (file, series), then by file. The group with the file's first
    record holds the header, which is taken out of its counts there. A file's widths are gathered in a list; as
    w different widths need w * w / 2 bytes, it is short even for a large file. ``as_of`` adds the check that the latest
    label is at most ``lag`` periods older. A file without any record fails the header checks.
    """
    rows = csv_records(spark, glob).withColumn("f", csv_fields(F.col("record")))
    numeric = lambda x: x.rlike(NUMERIC_TEXT_PATTERN) | ((x == "na") if allow_na else F.lit(False))
    cells = F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(1)))
    rows = rows.select("path", F.get("f", F.lit(0)).alias("series"), F.size("f").alias("width"),
                       F.size(F.filter(cells, lambda x: ~numeric(x))).cast("bigint").alias("bad"), F.struct("nth", "f").alias("at"))
    by_width = rows.groupBy("path", "series", "width").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), F.min(F.struct("at", "bad")).alias("first"))
    by_series = by_width.groupBy("path", "series").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("first").alias("first"), F.collect_list(F.struct("width", "n")).alias("widths"))
    wanted = {s: list(expected_series).count(s) for s in expected_series}
    want = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]).cast("map<string,bigint>"), F.col("series")), F.lit(0))
    off, off_less_header = ((F.col("n") - k != want).cast("bigint") for k in (0, 1))
    by_file = by_series.groupBy("path").agg(
        F.min(F.struct("first.at", "first.bad", (off_less_header - off).alias("adjust"))).alias("head"), F.sum("bad").alias("bad"),
        F.sum(off).alias("off"), F.sum((want > 0).cast("bigint")).alias("met"), F.flatten(F.collect_list("widths")).alias("widths"))
    found = file_list(spark, glob).select("path").join(by_file, "path", "left")
    fields = F.coalesce("head.at.f", F.array().cast("array<string>"))
    oldest = None
    if as_of is not None:
        oldest = (as_of.year * 4 + (as_of.month + 2) // 3 if kind == QUARTER else as_of.year) - lag
    checks = _header_violations(F.col("fields"), id_col, kind, min_labels, oldest)
    checks |= {
        "row width": F.aggregate("widths", F.lit(0).cast("bigint"), lambda t, x: t + F.when(x["width"] != F.size("fields"), x["n"]).otherwise(0)),
        "numeric cells": F.col("bad") - F.col("head.bad"),
        "expected series": F.col("off") + F.col("head.adjust") + len(wanted) - F.col("met")}
    empty = {"row width": 0, "numeric cells": 0, "expected series": len(wanted)}
    listed = [F.struct(F.lit(name).alias("check_name"), F.coalesce(c, F.lit(empty.get(name, 1))).cast("bigint").alias("violations")) for name, c in checks.items()]
    return found.withColumn("fields", fields).select("path", F.inline(F.array(*listed)))


def profile_files(spark: SparkSession, glob: str, kind: str) -> DataFrame:
    """Manifest rows: path, bytes, sha256, data rows, label count, min/max
    label index, the distinct series names in order (a file's own list: it has
    no more of them than records), their number and an order-insensitive hash."""
    idx = _label_index(kind)
    pattern = QUARTER_LABEL_PATTERN if kind == QUARTER else YEAR_LABEL_PATTERN
    rows = csv_records(spark, glob).withColumn("f", csv_fields(F.col("record")))
    by_series = rows.groupBy("path", F.get("f", F.lit(0)).alias("series")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("nth", "f")).alias("first"))
    by_file = by_series.groupBy("path").agg(F.min("first").alias("head"), F.sum("n").alias("n"), F.collect_list(F.struct("series", "n")).alias("counts"))
    name = F.get("head.f", F.lit(0))
    series = F.transform(F.filter("counts", lambda c: (c["series"] != name) | (c["n"] > 1)), lambda c: c["series"])
    body = by_file.select("path", F.slice("head.f", 2, F.greatest(F.size("head.f") - 1, F.lit(1))).alias("labels"),
                          (F.col("n") - 1).alias("rows"), F.array_sort(series).alias("series"))
    h = file_hashes(spark, glob).join(body, "path", "left")
    labels = F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: x.rlike(pattern))
    return h.select("path", "bytes", "sha256", F.size(labels).alias("labels"), F.array_min(F.transform(labels, idx)).alias("label_min_idx"),
                    F.array_max(F.transform(labels, idx)).alias("label_max_idx"), F.coalesce("rows", F.lit(0)).alias("rows"), "series",
                    F.coalesce(F.size("series"), F.lit(0)).cast("bigint").alias("series_count"),
                    F.aggregate(F.transform("series", lambda x: F.xxhash64(x).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"),
                                lambda a, b: (a + b).cast("decimal(38,0)")).cast("string").alias("series_hash"))


def manifest_mismatches(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files whose bytes differ from the recorded manifest, or that are
    missing on either side (full outer join on path)."""
    j = current.select("path", F.col("sha256").alias("now")).join(
        recorded.select("path", F.col("sha256").alias("then")), "path", "full_outer")
    return j.select("path", F.lit("manifest hash").alias("check_name"),
                    F.when(F.col("now").eqNullSafe(F.col("then")), 0).otherwise(1).cast("bigint").alias("violations"))
