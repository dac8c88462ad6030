"""All-or-nothing publication of several results.

A run stages every output in a folder of its own. Only when all of them are written, one small pointer is
appended: a JSON line that names the run's folder. Readers resolve the newest pointer, so they see either all
outputs of a run or none: a failing check stops before anything is staged, and a write that breaks off leaves
a folder that no pointer names. The pointer is one file, which Spark's committer moves into place when its task is done.
One run publishes to a root at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import gate

_POINTER = "run bigint, folder string, outputs map<string,string>"


class Output(NamedTuple):
    """A result and how it is written."""
    df: DataFrame
    format: str = "parquet"
    partition_by: Sequence[str] = ()
    options: Mapping[str, str] = {}


def current(spark: SparkSession, root: str):
    """The newest pointer (run, folder, outputs: name -> format), or None before the first publication."""
    try:
        rows = spark.read.schema(_POINTER).json(f"{root}/current")
        return rows.orderBy(F.desc("run")).limit(1).collect()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    except IndexError:
        return None


def publish(spark: SparkSession, root: str, outputs: Mapping[str, Output], checks: Mapping[str, DataFrame] | None = None) -> int:
    """Gate on ``checks`` (what -> check rows), stage all ``outputs``, then point to them; returns the run's number."""
    for what, rows in (checks or {}).items():
        gate(rows, what)
    folder = f"{root}/runs/{uuid.uuid4().hex}"
    for name, out in outputs.items():
        writer = out.df.write.mode("errorifexists").format(out.format).options(**out.options)
        (writer.partitionBy(*out.partition_by) if out.partition_by else writer).save(f"{folder}/{name}")
    before = current(spark, root)
    run = before["run"] + 1 if before else 1
    pointer = spark.createDataFrame([(run, folder, {n: o.format for n, o in outputs.items()})], _POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{root}/current")
    return run


def published(spark: SparkSession, root: str, name: str, **options) -> DataFrame:
    """Output ``name`` of the newest complete run."""
    now = current(spark, root)
    if now is None or name not in now["outputs"]:
        raise ValueError(f"{root} has no published {name!r}")
    return spark.read.format(now["outputs"][name]).options(**options).load(f"{now['folder']}/{name}")
