"""Content hashes for reproducibility checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORDED = "run bigint, name string, bucket bigint, rows bigint, content_hash string"


def table_hash(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash: one row (rows, content_hash).

    Each row hashes to a 64-bit xxhash over its columns in name order; the
    hashes are summed as DECIMAL(38,0) (no overflow, associative), so the
    result does not depend on partitioning or row order but does see
    duplicates. One partial+final aggregate."""
    cols = sorted(df.columns)
    h = F.xxhash64(*[F.col(f"`{c}`") for c in cols]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("content_hash"))


def bucket_hashes(df: DataFrame, keys: Sequence[str], buckets: int = 256) -> DataFrame:
    """(bucket, rows, content_hash): the content hash of every bucket of keys. Rows of a key share a bucket, so a change
    of one row shows in one bucket; the sum of all is the hash of the table."""
    key = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).alias("bucket")
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("content_hash"))


def recorded_hashes(spark: SparkSession, path: str) -> DataFrame:
    """All hashes of earlier runs: (run, name, bucket, rows, content_hash)."""
    try:
        return spark.read.schema(_RECORDED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _RECORDED)


def record_hashes(df: DataFrame, keys: Sequence[str], path: str, name: str, buckets: int = 256) -> DataFrame:
    """Append the bucket hashes of ``df`` to the hash table at ``path`` and compare them with the last run's of that name:
    (run, bucket, rows, rows_before, changed), one row a bucket of either run. In the first run everything has changed.
    The number of buckets stays as it was for a name, or all of them differ."""
    spark = df.sparkSession
    last = recorded_hashes(spark, path).where(F.col("name") == name).agg(F.max("run")).collect()[0][0]
    run = (last or 0) + 1
    (bucket_hashes(df, keys, buckets).select(F.lit(run).cast("bigint").alias("run"), F.lit(name).alias("name"), "bucket", "rows", "content_hash")
     .write.mode("append").parquet(path))
    rows = recorded_hashes(spark, path).where((F.col("name") == name) & (F.col("run") >= run - 1))
    now, before = F.col("run") == run, F.col("run") == run - 1
    both = rows.groupBy("bucket").agg(
        F.max(F.when(now, F.col("rows"))).alias("rows"), F.max(F.when(before, F.col("rows"))).alias("rows_before"),
        F.max(F.when(now, F.col("content_hash"))).alias("h1"), F.max(F.when(before, F.col("content_hash"))).alias("h0"))
    return both.select(F.lit(run).cast("bigint").alias("run"), "bucket", F.coalesce("rows", F.lit(0)).alias("rows"),
                       F.coalesce("rows_before", F.lit(0)).alias("rows_before"), (~F.col("h1").eqNullSafe(F.col("h0"))).alias("changed"))
