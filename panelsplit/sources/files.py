"""File sources and sinks: wide CSV landing files, manifests, gated writes.

Wide files are read as all-STRING columns (no schema inference); the period
columns are discovered from the header at plan time. Structural checks read
records as they are written (``csv_records``), since a reader with a header
would silently rename duplicates. Raw bytes, for hashing only, come from the
``binaryFile`` source, one file per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_wide(spark: SparkSession, paths: str | Sequence[str], null_value: str | None = None) -> DataFrame:
    """Wide CSV(s) with a header; every column STRING; the source file path
    kept as ``source_file`` so many files can be staged in one job."""
    r = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).option("escape", '"')
    if null_value is not None:
        r = r.option("nullValue", null_value)
    df = r.csv(paths if isinstance(paths, str) else list(paths))
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_annual_long(spark: SparkSession, paths, id_col: str = "series",
                     extra_ids: Sequence[str] = ()) -> DataFrame:
    """Annual wide file(s) with 'na' for missing -> (extra_ids..., series,
    year, value DOUBLE). ``extra_ids`` are non-year columns such as
    partition columns discovered from the folder names."""
    df = read_wide(spark, paths).drop("source_file")
    ids = [*extra_ids, id_col]
    cols = [c for c in df.columns if c not in ids]
    long = df.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot(ids, cols, "label", "raw")
    return long.select(*extra_ids, F.col(id_col).alias("series"), F.col("label").cast("bigint").alias("year"),
                       F.when(F.col("raw") != "na", F.col("raw").try_cast("double")).alias("value"))


def write_wide(wide: DataFrame, out_dir: str, entity: str, null_value: str = "") -> None:
    """One CSV (with header) per entity directory, rows by series, so that equal
    contents give equal bytes; ``null_value`` marks missing cells (e.g. 'na' for
    the annual file)."""
    (wide.repartition(entity).sortWithinPartitions(entity, "series").write.mode("overwrite").partitionBy(entity)
     .option("header", True).option("escape", '"').option("nullValue", null_value).option("emptyValue", null_value)
     .csv(out_dir))


def file_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """(path, bytes, sha256) per file, from its raw bytes."""
    b = spark.read.format("binaryFile").load(glob)
    return b.select(F.col("path"), F.col("length").alias("bytes"), F.sha2(F.col("content"), 256).alias("sha256"))


def file_list(spark: SparkSession, glob: str) -> DataFrame:
    """(path, bytes) per file of at least one byte; contents are not read."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("bytes"))


def csv_fields(record) -> Column:
    """Fields of one CSV record, in one pass; commas and line ends within double quotes belong to the field."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.rlike('(?s)^".*"$'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def csv_records(spark: SparkSession, glob: str) -> DataFrame:
    """(path, nth, record) of every record of every file as it is written, blank ones left out.

    A quoted field may hold line ends, so a file is read from its start, record by record, by one task and never as
    a whole; ``nth`` rises within a file, and its least number is the header's. The reader is given one column, so a record
    with more fields comes back as text, whatever its width or names."""
    raw = (spark.read.schema("first string, _text string").option("header", False).option("multiLine", True)
           .option("columnNameOfCorruptRecord", "_text").option("quote", '"').option("escape", '"').option("maxColumns", 1 << 20).csv(glob))
    return (raw.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("nth"),
                       F.coalesce("_text", "first").alias("record")).where(F.trim("record") != ""))
