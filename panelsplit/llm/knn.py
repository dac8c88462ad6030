"""Exact top-k search by inner product: a Voronoi kNN join.

A bounded sample of the vectors serves as pivots. Every data vector belongs to the cell of its nearest
pivot; queries are grouped by the first few pivots, so that a group holds about ``queries_per_group`` of
them. Each query first meets its group's own cell, which gives a lower bound of its k-th best score.
The group's summary is its pivot p, its radius r (the largest distance of a query from p) and the least
of those bounds. A data vector x can matter to the group only if p.x + r|x| reaches that bound, since
q.x = p.x + (q - p).x for every query q of the group; only then is it replicated to the group. The
replicas are solved locally, in blocks of bounded size (``block`` data vectors by ``queries_per_block``
queries), however many vectors one cell or group holds, and the blocks' best are merged.

Scores are integer inner products. Where vectors have different lengths, the shorter counts as padded
with zeros. Scores are exact; beyond the range of a long they are clipped to it.

Edge cases: a row whose id or vector is null, or that holds a null or non-finite component, takes no
part; rows equal in id and vector count once; rows with the query's id are the query's own; ties go to
the smaller id; fewer than k candidates give all of them; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsplit.llm.common import store, table

_LONG = 2 ** 63 - 1


def _unpack(raws) -> np.ndarray:
    """Rows of numbers; int16 where they fit ('s' first), else doubles ('d' first)."""
    rows = [np.frombuffer(r, "<i2" if r[:1] == b"s" else "<f8", offset=2 if r[:1] == b"s" else 8).astype(float) for r in raws]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    if rows and min(map(len, rows)) == width:
        return np.stack(rows)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _pack_row(v: np.ndarray) -> bytes:
    return b"s\0" + v.astype("<i2").tobytes() if not len(v) or np.abs(v).max() < 2 ** 15 else b"d" + b"\0" * 7 + v.astype("<f8").tobytes()


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, as int64."""
    width = max(q.shape[1], x.shape[1])
    q, x = _padded(q, width), _padded(x, width)
    if not width:
        return np.zeros((len(q), len(x)), np.int64)
    if max(1.0, np.abs(q).max()) * max(1.0, np.abs(x).max()) * width < 2 ** 53:
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    big = whole(q).dot(whole(x).T)
    return np.frompyfunc(lambda s: max(-_LONG - 1, min(_LONG, s)), 1, 1)(big).astype(np.int64)


def packed_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and the packed floor(scale * x) of every row that takes part, each once."""
    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or values is None or any(v is None for v in values):
                    continue
                v = np.floor(scale * np.array(values, float))
                if np.isfinite(v).all():
                    ids.append(i)
                    out.append(_pack_row(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, v binary").distinct()


def _with_cells(vectors: DataFrame, pivots: np.ndarray, query_every: int, groups: int) -> DataFrame:
    """Adds cell (the nearest pivot), and for queries group (the nearest of the first ``groups`` pivots) and distance from it."""
    def run(batches):
        for batch in batches:
            x = _unpack(batch.column(1).to_pylist())
            ids = batch.column(0).to_numpy()
            width = max(x.shape[1], pivots.shape[1])
            a, p = _padded(x, width), _padded(pivots, width)
            d = (a ** 2).sum(1)[:, None] - 2 * a @ p.T + (p ** 2).sum(1)
            group = d[:, :groups].argmin(1)
            near = np.sqrt(np.maximum(0, d[np.arange(len(a)), group]))
            query = ids % query_every == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(d.argmin(1).astype(np.int32)),
                 pa.array(group.astype(np.int32), mask=~query), pa.array(near, mask=~query)],
                names=["vec_id", "v", "cell", "group", "distance"])

    return vectors.mapInArrow(run, "vec_id bigint, v binary, cell int, group int, distance double")


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _solver(k: int):
    """applyInPandas body: best k of the block's data for each of its queries, no worse than the query's bound."""
    def solve(block: pd.DataFrame) -> pd.DataFrame:
        queries, data = block[block["is_query"]], block[~block["is_query"]]
        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        scores = _products(_unpack(queries["v"]), _unpack(data["v"]))
        ids, own, bound = data["vec_id"].to_numpy(), queries["vec_id"].to_numpy(), queries["bound"].to_numpy()
        found = []
        for i in range(len(own)):
            s = scores[i]
            may = np.flatnonzero((ids != own[i]) & (s >= bound[i]))
            if len(may) > k:
                least = np.partition(s[may], len(may) - k)[len(may) - k]
                may = may[s[may] >= least]
            best = may[np.lexsort((ids[may], -s[may]))][:k]
            found.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[best], "score": s[best]}))
        return pd.concat(found)
    return solve


def _dealt(queries: DataFrame, data: DataFrame, data_blocks: int, query_blocks: dict[int, int]) -> DataFrame:
    """Queries copied to every block of data, and data to every block of queries that its group has (none without queries)."""
    own = F.create_map(*[F.lit(x) for kv in query_blocks.items() for x in kv])[F.col("group")]

    def block(n, by):
        return F.pmod(F.xxhash64("vec_id", F.lit(by)), n).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    query_blocks, data_blocks = own, F.lit(data_blocks)
    q = queries.select("group", block(query_blocks, "q").alias("qb"), every(data_blocks).alias("db"), "vec_id", "v", "bound", F.lit(True).alias("is_query"))
    d = data.select("group", every(query_blocks).alias("qb"), block(data_blocks, "d").alias("db"), "vec_id", "v", F.lit(None).cast("long").alias("bound"), F.lit(False).alias("is_query"))
    return q.unionByName(d).withColumn("bound", F.coalesce("bound", F.lit(-_LONG - 1)))


def _solve(queries: DataFrame, data: DataFrame, k: int, data_blocks: int, query_blocks: dict[int, int]) -> DataFrame:
    """queries: group, vec_id, v, bound; data: group, vec_id, v. Every block of queries meets every block of its group's data."""
    return _dealt(queries, data, data_blocks, query_blocks).groupBy("group", "qb", "db").applyInPandas(_solver(k), _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, query_every: int = 20, k: int = 20, scale: int = 64, pivots: int = 32,
          queries_per_group: int = 2048, block: int = 4096, queries_per_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best of ``rows`` (vec_id, embedding) for every row whose id is divisible by ``query_every``."""
    vectors = store(packed_vectors(rows, scale), "vectors")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()
    number = vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % query_every == 0, 1)).alias("m")).collect()[0]
    if not number["n"] or not number["m"]:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    centres = _unpack([bytes(r["v"]) for r in sample])
    groups = min(len(centres), math.ceil(number["m"] / queries_per_group))
    cells = store(_with_cells(vectors, centres, query_every, groups), "cells")
    queries = cells.where(F.col("group").isNotNull())
    data_blocks = math.ceil(number["n"] / block)
    # By group, as a group meets no other's queries; at most one entry a pivot.
    query_blocks = {r["group"]: math.ceil(r["count"] / queries_per_block) for r in queries.groupBy("group").count().collect()}

    # First the own cell: group g meets the cell of the same pivot, in as many blocks as it fills.
    largest = cells.where(F.col("cell") < groups).groupBy("cell").count().agg(F.max("count")).collect()[0][0] or 1
    own = _solve(queries.withColumn("bound", F.lit(-_LONG - 1)),
                 cells.where(F.col("cell") < groups).select(F.col("cell").alias("group"), "vec_id", "v"),
                 k, math.ceil(largest / block), query_blocks)
    first = store(_best(own, k), "own-cell")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = queries.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-_LONG - 1)))
    summary = {r["group"]: (r["radius"], r["bound"]) for r in
               bounded.groupBy("group").agg(F.max("distance").alias("radius"), F.min("bound").alias("bound")).collect()}

    def replicate(batches):
        for batch in batches:
            x = _unpack(batch.column(1).to_pylist())
            cell = batch.column(2).to_numpy()
            width = max(x.shape[1], centres.shape[1])
            a, p = _padded(x, width), _padded(centres, width)
            norm = np.sqrt((a ** 2).sum(1))
            for g, (radius, bound) in summary.items():
                slack = 1 + 1e-9 * norm * (np.linalg.norm(p[g]) + radius)
                keep = (cell != g) & (a @ p[g] + radius * norm + slack >= float(bound))
                at = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), g, np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["group", "vec_id", "v"])

    replicas = cells.mapInArrow(replicate, "group int, vec_id bigint, v binary")
    rest = _solve(bounded, replicas, k, data_blocks, query_blocks)
    return _best(first.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
