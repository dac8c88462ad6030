import random

import numpy as np
from pyspark.sql import types as T

from panelsplit.llm.knn import _dealt, top_k

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("cell", T.StringType())])


def _brute(rows, every, k):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v):
            kept.setdefault((i, tuple(int(x) for x in np.floor(64 * np.array(v, "f4").astype(float)))), None)
    out = []
    for i, q in kept:
        if i % every == 0:
            found = sorted(((-sum(a * b for a, b in zip(q, x)), j) for j, x in kept if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def _run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in top_k(df, **kw).collect())


def test_against_brute_force_with_many_blocks(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 2) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 4]]) for i in range(400)]
    rows += [(500 + i, list(rows[3][1])) for i in range(60)]  # ties
    for groups in (4, 1000):
        assert _run(spark, rows, query_every=5, k=7, pivots=6, queries_per_group=groups, block=64, queries_per_block=16) == _brute(rows, 5, 7)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [1.0, None]), (80, [inf, 0.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, []), (3, [1e30, -1e30]), (100, [2000.0, 1.0])]
    got = _run(spark, rows)
    want = [r for r in _brute(rows, 20, 20)]
    clip = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    assert got == [(a, b, c, clip(d)) for a, b, c, d in want]


def test_few_or_no_rows(spark):
    assert _run(spark, []) == [] and _run(spark, [(1, [1.0])]) == [] and _run(spark, [(20, [1.0])]) == []


def test_data_goes_to_the_blocks_of_its_group(spark):
    queries = spark.createDataFrame([(i % 2, i, b"s\0", 0) for i in range(8)], "group int, vec_id long, v binary, bound long")
    data = spark.createDataFrame([(i % 3, i, b"s\0") for i in range(30)], "group int, vec_id long, v binary")
    got = _dealt(queries, data, 2, {0: 3, 1: 1})
    assert got.where("is_query").count() == 8 * 2
    assert {r["group"]: r["count"] for r in got.where("not is_query").groupBy("group").count().collect()} == {0: 10 * 3, 1: 10}
