"""Quality classifier by compression against dictionaries of good and of bad text.

Two zstandard raw-content dictionaries hold labelled text of either class. A text is compressed with
each; the difference of the sizes per byte of text says which class it resembles. A logistic curve,
fitted on other labelled rows, turns the difference (and how much the length lets one trust it) into
the probability of label 1.

The fit uses a bounded sample of labelled rows: ``dictionary_rows`` a class fill the dictionaries
(``dictionary_bytes`` each, at most ``piece_bytes`` of one text) and ``calibration_rows`` a class fit
the curve. Rows are drawn by a hash of their id. Scoring covers whole texts of every row.

Edge cases: null and empty texts get the score of a text of no length (the share of label 1); rows
without a label or with a null text are not learned from; if a class has no labelled row, the score
is the share of label 1 everywhere (0.5 without any label); equal rows get equal scores; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsplit.llm.common import id_remainder, slices, table


class QualityModel(NamedTuple):
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int


def _compressor(content: bytes, level: int):
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _sizes(good: bytes, bad: bytes, level: int):
    """mapInArrow body: the columns before text pass through; the text becomes its length in bytes and two compressed sizes."""
    def run(batches):
        to_good, to_bad = _compressor(good, level), _compressor(bad, level)
        for batch in slices(batches):
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array([len(r) for r in raws], pa.int64()), pa.array([len(to_good.compress(r)) for r in raws], pa.int64()),
                        pa.array([len(to_bad.compress(r)) for r in raws], pa.int64())],
                names=[batch.schema.names[i] for i in range(len(kept))] + ["n_bytes", "good_size", "bad_size"])
    return run


def _features(n, good, bad):
    n = np.asarray(n, float)
    diff = (np.asarray(bad, float) - np.asarray(good, float)) / np.maximum(n, 1)
    trust = np.log1p(n) / 8
    return np.stack([np.ones_like(n), 20 * diff, 20 * diff * trust, trust * (n > 0)], axis=1)


def _logistic(x, y, ridge=1e-2, rounds=50):
    """Newton's method on the ridge-penalised log-likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, dictionary_rows: int = 1500, calibration_rows: int = 3000,
                dictionary_bytes: int = 1 << 20, piece_bytes: int = 3000, level: int = 6) -> QualityModel:
    """Fit on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) mark.

    At most ``dictionary_rows + calibration_rows`` labels a class are drawn; only their texts are fetched.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    prior = math.log((share * total + 0.5) / ((1 - share) * total + 0.5))
    if not counts.get(0) or not counts.get(1):
        return QualityModel(b"", b"", (prior, 0.0, 0.0, 0.0), level)
    ids = [(r["doc_id"], y, nth) for y in (0, 1) for nth, r in enumerate(
        marked.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(dictionary_rows + calibration_rows).collect(), 1)]
    drawn = (docs.where(F.col("text").isNotNull()).select("doc_id", "text")
             .join(F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id bigint, quality int, nth int")), "doc_id"))
    # A class of few rows gives half of them to the dictionary.
    half = {y: max(1, min(dictionary_rows, n // 2)) for y, n in counts.items()}
    for_dictionary = F.col("nth") <= F.when(F.col("quality") == 1, half[1]).otherwise(half[0])
    # Where a text is longer than its share of the dictionary, the piece starts at a place drawn by hash.
    room = F.greatest(F.length("text") - piece_bytes, F.lit(0))
    piece = F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit("piece")), room + 1) + 1).cast("int"), F.lit(piece_bytes))
    pieces = drawn.where(for_dictionary).select("quality", "nth", piece.alias("piece")).collect()
    content = {y: "\n".join(r["piece"] for r in sorted(pieces, key=lambda r: (r["nth"], r["piece"])) if r["quality"] == y)
               .encode("utf-8", "surrogatepass")[:dictionary_bytes] for y in (0, 1)}
    sizes = (drawn.where(~for_dictionary).select("quality", "text")
             .mapInArrow(_sizes(content[1], content[0], level), "quality int, n_bytes long, good_size long, bad_size long").toPandas())
    if sizes["quality"].nunique() < 2:
        return QualityModel(content[1], content[0], (prior, 1.0, 0.0, 0.0), level)
    x, y = _features(sizes["n_bytes"], sizes["good_size"], sizes["bad_size"]), sizes["quality"].to_numpy(float)
    w = _logistic(x, y)
    # The sample holds the classes in other shares than the labels do: move the intercept to the labels' shares.
    w[0] += math.log(counts[1] / counts[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return QualityModel(content[1], content[0], tuple(map(float, w)), level)


def score_quality(docs: DataFrame, model: QualityModel, *keep: str | Column) -> DataFrame:
    """The columns ``keep`` and score, the calibrated probability of label 1, for every row."""
    rows = docs.select(*keep, F.col("text").alias("scored text"))
    kept = rows.drop("scored text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "score double"])

    def run(batches):
        for batch in _sizes(model.good, model.bad, model.level)(batches):
            n = batch.num_columns - 3
            x = _features(*(batch.column(n + i).to_numpy() for i in range(3)))
            score = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [pa.array(score)], names=batch.schema.names[:n] + ["score"])

    return rows.mapInArrow(run, schema)


#: A document counts as good from this score on.
THRESHOLD = 0.7
#: Rows with this remainder of crc32 modulo 4 are held out.
HELD_OUT = 2


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``."""
    at = docs.columns.index("text")
    sizes, weights = _sizes(model.good, model.bad, model.level), np.array(model.weights)

    def run(batches):
        held = []

        def texts():
            for batch in slices(batches):
                held.append(batch)
                yield batch.select([at])

        for measured in sizes(texts()):
            score = 1 / (1 + np.exp(-np.clip(_features(*(c.to_numpy() for c in measured.columns)) @ weights, -30, 30)))
            yield held.pop().filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: not of held-out rows."""
    return labels.where(id_remainder("doc_id", 4) != HELD_OUT)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, learnable(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(id_remainder("doc_id", 4) == HELD_OUT, F.lit(False)).alias("held_out")
    return score_quality(docs, model, "doc_id", held_out).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
