"""Publication of several outputs at once, manifests and their history."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelsplit.functions.periods import label_of_index
from panelsplit.operators import manifest as MF
from panelsplit.operators import publish as PB
from panelsplit.operators.checks import GateError


def outputs(spark, n, breaks=False):
    second = spark.range(n).select(F.col("id").cast("string").alias("v"))
    if breaks:
        second = second.select(F.when(F.col("v") != "", F.raise_error(F.lit("disk full"))).alias("v"))
    return {"a": PB.Output(spark.range(n)), "b": PB.Output(second, "csv", options={"header": "true"})}


def seen(spark, root):
    return PB.published(spark, root, "a").count(), PB.published(spark, root, "b", header="true").count()


def test_readers_see_whole_runs_only(spark, tmp_path):
    root = str(tmp_path / "out")
    assert PB.current(spark, root) is None
    with pytest.raises(ValueError):
        PB.published(spark, root, "a")
    assert PB.publish(spark, root, outputs(spark, 3)) == 1 and seen(spark, root) == (3, 3)
    bad = spark.createDataFrame([("k", "c", 1)], "k string, check_name string, violations bigint")
    with pytest.raises(GateError):
        PB.publish(spark, root, outputs(spark, 5), {"checks": bad})
    assert seen(spark, root) == (3, 3)
    with pytest.raises(PySparkException):
        PB.publish(spark, root, outputs(spark, 5, breaks=True))
    assert seen(spark, root) == (3, 3)
    assert PB.publish(spark, root, outputs(spark, 7), {"checks": bad.where("violations = 0")}) == 2 and seen(spark, root) == (7, 7)


def state(spark, files):
    rows = [(n, (None, 1, sha, 1, 1, "a", "b", ["s"])) for n, sha in files.items()]
    return spark.createDataFrame(rows, f"name string, info {MF.INFO}")


def test_history_tells_every_change(spark, tmp_path):
    table = str(tmp_path / "history")
    steps = [
        ({"a": "1", "b": "2", "c": "3", "d": "4"}, {("a", "added", None), ("b", "added", None), ("c", "added", None), ("d", "added", None)}),
        ({"a": "1", "b": "x", "e": "3", "f": "1"}, {("a", "unchanged", None), ("b", "changed", None), ("e", "moved", "c"), ("d", "removed", None), ("f", "added", None)}),
        ({"a": "1", "b": "2", "d": "4", "e": "3", "f": "1"}, {("a", "unchanged", None), ("b", "changed", None), ("d", "added", None), ("e", "unchanged", None), ("f", "unchanged", None)}),
        ({}, {(n, "removed", None) for n in "abdef"}),
        ({}, set()),
    ]
    for run, (files, want) in enumerate(steps, 1):
        got = MF.record(state(spark, files), table).collect()
        assert {(r["name"], r["status"], r["moved_from"]) for r in got} == want and len(got) == len(want)
        assert all(r["run"] == run for r in got)
    # The history keeps every run: a file as it was last seen before the third one.
    before = {r["name"]: r["info"]["sha256"] for r in MF.last_seen(MF.history(spark, table), 3).collect()}
    assert before == {"a": "1", "b": "x", "e": "3", "f": "1"}


def test_documents_are_nested(spark, tmp_path):
    path = str(tmp_path / "docs")
    now = state(spark, {"x/q.csv": "1", "x/a.csv": "2", "y/q.csv": "3"})
    MF.write_documents(now, F.substring_index("name", "/", 1), "somewhere", "2020-01-01", path)
    docs = MF.read_documents(spark, path)
    assert docs.schema["files"].dataType.simpleString().startswith("map<string,struct<")
    got = {r["k"]: r for r in docs.select(F.map_keys("files").alias("k"), F.col("files")["x/q.csv"]["series"][0].alias("s"), "source").withColumn("k", F.array_join("k", ",")).collect()}
    assert set(got) == {"x/a.csv,x/q.csv", "y/q.csv"} and got["x/a.csv,x/q.csv"]["s"] == "s" and got["y/q.csv"]["s"] is None
    (tmp_path / "docs" / "part-x.txt").write_text("not json\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|JsonParseException|not json"):
        MF.read_documents(spark, path).collect()


def test_label_of_index(spark):
    got = [r[0] for r in spark.createDataFrame([(2026 * 4 + 2,), (1999 * 4 + 4,), (2000 * 4 + 1,)], "i int").select(label_of_index("i")).collect()]
    assert got == ["2026 Q2", "1999 Q4", "2000 Q1"]
