"""Periodic runs in word sequences: grid enumeration driven by longest common extensions.

A run is a stretch of words with smallest period q, at least ``exponent`` times q and ``least`` words long,
that no neighbouring word extends with the same period. Finding them takes two steps:

* **Grid.** In such a stretch the words x and x + q are equal at (exponent - 1) * q places x in a row, so one
  of the multiples of (exponent - 1) * q is among them. Only these places are looked at, for every q: about
  n * ln(n) / (exponent - 1) pairs for n words. Each equal pair is extended to both sides.
* **Extensions.** How far two places agree (LCE) comes from a difference cover: of any two places, some
  common shift of fewer than ``COVER`` words leads to two sampled ones. The words up to there are compared
  one by one (most pairs end here); from two sampled places on, the answer is the least entry between them
  in the array of common prefixes of the sorted sampled suffixes, which a sparse table answers in two looks.
  Only sampled suffixes are sorted, a fifth of all, and only for documents in which a pair gets that far.

Documents are independent: one map over the table, nothing is shuffled. A task holds one document's arrays at
a time: its words, and some 30 numbers for each sampled place.

Edge cases: a null or empty text, or one without words, has no words and no runs; a null doc_id is a value like
others; repeated rows get equal answers; texts are read whole, however long (the grid is walked in pieces of
``PAIRS`` places); extra columns are ignored or, if asked for by name, kept; an empty table gives an empty result.
Runs that cover the same words count once, with the smallest period; of two runs of the greatest length the one
that starts first is the greatest, then the one with the smaller period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsplit.llm.common import table

#: Difference cover: every number modulo 31 is a difference of two of these.
COVER = 31
MARKS = (1, 5, 11, 24, 25, 27)
#: Grid places looked at together.
PAIRS = 1 << 20


def _shifts() -> np.ndarray:
    """For two places modulo COVER the least shift that brings both to marks."""
    out = np.zeros((COVER, COVER), np.int64)
    for a in range(COVER):
        for b in range(COVER):
            out[a, b] = next(s for s in range(COVER) if (a + s) % COVER in MARKS and (b + s) % COVER in MARKS)
    return out


SHIFTS = _shifts()


class Extensions:
    """Longest common extensions to the right of places in a sequence of word numbers."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self._sampled = None

    def _sort_sampled(self):
        """Sort the sampled suffixes; keep their ranks and the sparse table of common prefixes of neighbours."""
        w, n = self.words, len(self.words)
        at = np.flatnonzero(np.isin(np.arange(n) % COVER, MARKS))
        padded = np.concatenate([w, np.full(COVER, -1, w.dtype)])
        blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, COVER)[at])
        rows = blocks.view(np.dtype((np.void, blocks.dtype.itemsize * COVER))).ravel()
        rank = np.unique(rows, return_inverse=True)[1].astype(np.int64)  # any order of blocks will do, if it is the same for all
        index = np.full(n + COVER + 1, len(at), np.int64)  # of a sampled place; len(at) stands for the end
        index[at] = np.arange(len(at))
        # Names of the next 1, 2, 4, ... blocks; the end has the name -1.
        levels, step = [np.append(rank, -1)], COVER
        while levels[-1].max() + 1 < len(at):
            follow = index[np.minimum(at + step, n)]
            both = levels[-1][:-1] * (len(at) + 1) + levels[-1][follow] + 1
            levels.append(np.append(np.unique(both, return_inverse=True)[1], -1))
            step *= 2
        rank = levels[-1][:-1]
        order = np.empty(len(at), np.int64)
        order[rank] = np.arange(len(at))
        # Common prefixes of neighbours: whole blocks by the names, largest steps first, then word by word.
        a, b = at[order[:-1]].copy(), at[order[1:]].copy()
        for k in range(len(levels) - 1, -1, -1):
            ia, ib = index[np.minimum(a, n)], index[np.minimum(b, n)]
            same = (ia < len(at)) & (ib < len(at)) & (levels[k][ia] == levels[k][ib])
            a[same] += COVER << k
            b[same] += COVER << k
        a, b = np.minimum(a, n), np.minimum(b, n)
        common = a - at[order[:-1]] + self._compare(a, b, np.full(len(a), COVER, np.int64))[0]
        tables = [common]
        while 2 << len(tables) - 1 <= len(common):
            half = 1 << len(tables) - 1
            tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
        self._sampled = index, rank, tables

    def _compare(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from a and b on, ``most`` at most, and whether they stopped before that number."""
        w, n = self.words, len(self.words)
        most = np.minimum(most, n - np.maximum(a, b))
        equal, open_ = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        stopped = np.zeros(len(a), bool)
        t = 0
        while len(open_):
            same = w[a[open_] + t] == w[b[open_] + t]
            stopped[open_[~same]] = True
            t += 1
            equal[open_[same]] = t
            open_ = open_[same]
            open_ = open_[most[open_] > t]
        return equal, stopped

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.words)
        shift = SHIFTS[a % COVER, b % COVER]
        out, stopped = self._compare(a, b, shift)
        far = np.flatnonzero(~stopped & (np.maximum(a, b) + shift < n))
        if len(far):
            if self._sampled is None:
                self._sort_sampled()
            index, rank, tables = self._sampled
            x, y = rank[index[(a + shift)[far]]], rank[index[(b + shift)[far]]]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            level = np.floor(np.log2(hi - lo)).astype(np.int64)
            for k in np.unique(level):
                at = level == k
                t = tables[k]
                out[far[at]] = shift[far[at]] + np.minimum(t[lo[at]], t[hi[at] - (1 << k)])
        return out


def _grid(n: int, exponent: int):
    """(places x, periods q) in pieces: x multiples of (exponent - 1) * q with x + q < n."""
    q = np.arange(1, n // exponent + 1)
    places = (n - q - 1) // ((exponent - 1) * q) + 1
    ends = np.cumsum(places)
    first = 0
    while first < len(q):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        of = np.repeat(q[first:last], places[first:last])
        nth = np.arange(len(of)) - np.repeat(ends[first:last] - places[first:last] - (ends[first - 1] if first else 0), places[first:last])
        yield nth * of * (exponent - 1), of
        first = last


def find_runs(words: np.ndarray, exponent: int = 4, least: int = 6) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of word numbers, by start and period."""
    n = len(words)
    right, left = Extensions(words), Extensions(words[::-1])
    found = []
    for x, q in _grid(n, exponent):
        hit = np.flatnonzero(words[x] == words[x + q])
        if not len(hit):
            continue
        x, q = x[hit], q[hit]
        before = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(x > 0)
        before[inner] = left(n - x[inner] - q[inner], n - x[inner])
        length = right(x, x + q) + before + q
        long_ = length >= np.maximum(least, exponent * q)
        if long_.any():
            found.append(np.stack([x[long_] - before[long_], length[long_], q[long_]], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)  # of the same words the smallest period
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbered(words: list[bytes]) -> np.ndarray:
    number = dict(zip(dict.fromkeys(words), range(len(words))))
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def periodic_runs(docs: DataFrame, *keep: str | Column, exponent: int = 4, least: int = 6) -> DataFrame:
    """The columns ``keep``, n_words, runs (start, length, period in words) and collapsed (the words, joined by a space,
    that no run holds after its first period) for every row of ``docs``."""
    rows = docs.select(*keep, "text")
    kept = rows.drop("text") if keep else rows.select()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields),
                        "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"])

    def run(batches):
        for batch in batches:
            n = batch.num_columns - 1
            lengths, listed, collapsed = [], [], []
            for text in batch.column(n).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes: at ASCII white space only
                runs = find_runs(_numbered(words), exponent, least)
                lengths.append(len(words))
                listed.append([{"start": s, "length": m, "period": q} for s, m, q in runs.tolist()])
                if len(runs):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
                    words = [w for w, covered in zip(words, np.cumsum(edge).tolist()) if not covered]
                collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array(lengths, pa.int64()), pa.array(listed, run_type), pa.array(collapsed, pa.string())],
                names=batch.schema.names[:n] + ["n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, schema)


def run_digest(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs(docs, "doc_id")``: the number of runs, the longest, and digests of runs and kept words."""
    written = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("minus_start"), (-r["period"]).alias("minus_period"))))
    top = found.withColumn("top", longest)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.minus_start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.minus_period")).alias("period"), F.expr("1000 * top.length div -top.minus_period").alias("exponent_milli"),
        F.sha2(written.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; by a hash of its id a tenth of the documents repeats some of its words to its end."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = """
        array_join(transform(sequence(0, size(words) - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')"""
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.size("words") > 0, F.expr("g % size(words)")))
    rows = rows.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.expr(planted)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), "doc_id"))
