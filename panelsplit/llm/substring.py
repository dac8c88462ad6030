"""Substring deduplication by lookup of windows, in place of a relative Lempel-Ziv parse.

A duplicate span is a run of words all of whose windows of ``window`` words occur in an earlier document (one
with a smaller doc_id). All documents are indexed by their windows in blocks: the window's hash says which
block holds it, and every document is looked up in every block that could hold one of its windows. No
document is matched against a reference text: the windows of a span may be of several documents, and the span
need not occur whole in any one of them.

Most windows occur once, so the index is built of those that may recur:

1. Seeds: in every window the smallest hash of its runs of ``seed`` words. Equal windows have equal seeds.
   Seeds that several documents hold are found first.
2. Only windows with such a seed go to the index, which finds the smallest doc_id that holds a window.

Both steps combine what meets within a task before the shuffle: a task sends one entry for a hash, that of
its smallest document, to the hash's block, and answers the others itself: these answers are grouped by document,
not by hash. So a passage that a third of the documents share costs its block an entry a task, not one a
document. Entries travel packed, a row for each task and block.

Hashes have 64 bits. Words are runs of characters other than ASCII white space, unchanged.

Edge cases: a null text has no words; a document never repeats itself (rows that share a doc_id are one
document, each row keeps its own words); rows with a null doc_id are neither reference nor cut; texts
shorter than a window stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsplit.llm.common import shuffle_partitions, table
from panelsplit.llm.neardup import WordHashes

#: Words of a task that are combined before they are sent.
FLUSH_WORDS = 1 << 21
_BASE = 0xD6E8FEB86659FD93


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``width`` words, built from runs of powers of two."""
    n = len(h) - width + 1
    out, done, power, step = None, 0, h, 1
    with np.errstate(over="ignore"):
        while step <= width:
            if width & step:
                part = power[done:done + n]
                out = part.copy() if out is None else out * np.uint64(pow(_BASE, step, 1 << 64)) + part
                done += step
            if 2 * step <= width:
                power = power[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + power[step:]
            step *= 2
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive hashes."""
    out, have = h, 1
    while have < width:
        by = min(have, width - have)
        out = np.minimum(out[:-by], out[by:])
        have += by
    return out


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(split: list[bytes], words: WordHashes) -> np.ndarray:
    return np.fromiter(map(words.__getitem__, split), np.uint64, len(split))


def window_seeds(h: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The seed of every window."""
    return _least(_runs(h, seed), window - seed + 1)


def _by_value(values: np.ndarray, ids: np.ndarray):
    """Order by value and id, and for the ordered entries the smallest and largest id of their value."""
    order = np.lexsort((ids, values))
    v, i = values[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(v)))
    return order, np.repeat(i[starts], size), np.repeat(i[starts + size - 1], size)


_ENTRIES = "block int, known boolean, value binary, owner binary, position binary, ids binary, row_keys binary"
_ARROW = pa.schema([("block", pa.int32()), ("known", pa.bool_()), ("value", pa.binary()), ("owner", pa.binary()), ("position", pa.binary()), ("ids", pa.binary()), ("row_keys", pa.binary())])


def _packed(blocks: int, known: bool, value, owner, position, ids, row_keys) -> pa.RecordBatch:
    """Entries packed a row for each block; owner becomes an index into the row's own ids.

    What is asked goes to the block of its value, what is known to one of as many more blocks by its document."""
    with np.errstate(over="ignore"):
        block = (((ids[owner].astype(np.uint64) * np.uint64(_BASE)) if known else (value * np.uint64(0xBF58476D1CE4E5B9))) >> np.uint64(33)) % np.uint64(blocks)
    block += np.uint64(blocks if known else 0)
    order = np.lexsort((position, owner, block))
    block, value, owner, position = block[order], value[order], owner[order], position[order]
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
    rows = []
    for a, b in zip(at, [*at[1:], len(block)]):
        who, mine = np.unique(owner[a:b], return_inverse=True)
        rows.append((int(block[a]), known, value[a:b].astype("<u8").tobytes(), mine.astype("<u4").tobytes(), position[a:b].astype("<u4").tobytes(),
                     ids[who].astype("<i8").tobytes(), row_keys[who].astype("<u4").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, _ARROW.types)], schema=_ARROW)


def _entries(blocks: int, of_document, answers_max: bool):
    """mapInArrow body over (doc_id, row_key, text[, marks]): what a task knows by itself, and what it asks the blocks.

    ``of_document(split, hashes, marks)`` gives a document's distinct values and their positions. An entry is
    known if its value has another document in the task: any other (``answers_max``), or a smaller one.
    """
    def flush(held):
        ids, row_keys = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
        owner = np.repeat(np.arange(len(held)), [len(r[2]) for r in held])
        value, position = np.concatenate([r[2] for r in held]), np.concatenate([r[3] for r in held])
        order, low, high = _by_value(value, ids[owner])
        value, position, owner = value[order], position[order], owner[order]
        mine = ids[owner]
        known = low != high if answers_max else mine > low
        for flag, pick in ((True, known), (False, mine == low)):
            yield _packed(blocks, flag, value[pick], owner[pick], position[pick], ids, row_keys)

    def run(batches):
        words, held, n = WordHashes(), [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for doc_id, row_key, text, *marks in zip(*columns):
                if doc_id is None or text is None:
                    continue
                split = _split(text)
                value, position = of_document(_hashes(split, words), *marks)
                if len(value):
                    held.append((doc_id, row_key, value, position))
                    n += len(split)
                if n >= FLUSH_WORDS:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


_ANSWERS = "part int, ids binary, row_keys binary, found binary"


def _answers(answers_max: bool, payload: str, parts: int):
    """applyInArrow body, one block of the index: known entries, and those whose value has another (or a smaller) document.

    Answers travel packed as well, a row for each block and part of the documents."""
    def run(block: pa.Table) -> pa.Table:
        value, position, ids, row_keys, known = [], [], [], [], []
        for r in block.to_pylist():
            owner = np.frombuffer(r["owner"], "<u4")
            value.append(np.frombuffer(r["value"], "<u8"))
            position.append(np.frombuffer(r["position"], "<u4"))
            ids.append(np.frombuffer(r["ids"], "<i8")[owner])
            row_keys.append(np.frombuffer(r["row_keys"], "<u4")[owner])
            known.append(np.full(len(owner), r["known"]))
        value, position, ids, row_keys, known = map(np.concatenate, (value, position, ids, row_keys, known))
        asked = np.flatnonzero(~known)
        order, low, high = _by_value(value[asked], ids[asked])
        yes = low != high if answers_max else ids[asked][order] > low
        pick = np.concatenate([np.flatnonzero(known), asked[order[yes]]])
        with np.errstate(over="ignore"):
            part = ((ids[pick].astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(33)) % np.uint64(parts)
        order = np.lexsort((row_keys[pick], ids[pick], part))
        pick, part = pick[order], part[order]
        what = (value if payload == "value" else position)[pick]
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        ends = [*at[1:], len(part)]
        return pa.table({"part": pa.array([int(part[a]) for a in at], pa.int32()),
                         **{name: pa.array([x[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())
                            for name, x in (("ids", ids[pick]), ("row_keys", row_keys[pick]), ("found", what))}})

    return run


def _gathered(answers: DataFrame, size: int) -> DataFrame:
    """doc_id, row_key and all that was found for the row; ``size`` bytes a finding."""
    def gather(part: pa.Table) -> pa.Table:
        ids, row_keys, found = (np.concatenate([np.frombuffer(x, t) for x in part.column(c).to_pylist()])
                                for c, t in (("ids", "<i8"), ("row_keys", "<u4"), ("found", f"<u{size}")))
        order = np.lexsort((row_keys, ids))
        i, k, raw = ids[order], row_keys[order], found[order].tobytes()
        at = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])])) if len(i) else np.zeros(0, np.int64)
        return pa.table({"doc_id": pa.array(i[at]), "row_key": pa.array(k[at].astype(np.int64)),
                         "found": pa.array([raw[size * a:size * b] for a, b in zip(at, [*at[1:], len(i)])], pa.binary())})

    return answers.groupBy("part").applyInArrow(gather, "doc_id bigint, row_key bigint, found binary")


def duplicate_windows(docs: DataFrame, window: int = 13, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, row_key, text), and for those that repeat an earlier one the first positions of
    the repeated windows: doc_id, row_key, found (packed positions)."""
    blocks = shuffle_partitions(docs.sparkSession)
    # row_key tells rows of one doc_id apart. The text is dealt out once; both joins below reuse the exchange.
    rows = docs.select("doc_id", (F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))).alias("row_key"), "text")
    dealt = rows.repartition("doc_id", "row_key")

    def seeds(h):
        if len(h) < window:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        v = np.unique(window_seeds(h, window, seed))
        return v, np.zeros(len(v), np.uint32)

    def windows(h, marks):
        marked = np.unique(np.frombuffer(marks, "<u8"))
        of = window_seeds(h, window, seed)
        k = np.minimum(np.searchsorted(marked, of), len(marked) - 1)
        position = np.flatnonzero(marked[k] == of)
        value, first = np.unique(_runs(h, window)[position], return_index=True)
        return value, position[first].astype(np.uint32)

    shared = rows.mapInArrow(_entries(blocks, seeds, True), _ENTRIES).groupBy("block").applyInArrow(_answers(True, "value", blocks), _ANSWERS)
    marks = _gathered(shared, 8).withColumnRenamed("found", "marks")
    marked = dealt.join(marks, ["doc_id", "row_key"], "left").select("doc_id", "row_key", F.when(F.col("marks").isNotNull(), F.col("text")).alias("text"), "marks")
    repeated = marked.mapInArrow(_entries(blocks, windows, False), _ENTRIES).groupBy("block").applyInArrow(_answers(False, "position", blocks), _ANSWERS)
    return dealt, _gathered(repeated, 4)


def factors(repeated: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy parse: (start, end) in words of the factors of at least ``window`` words.

    ``repeated`` says for every window whether the index holds it. A factor starts at the first repeated
    window and grows by a word as long as the window that ends there is repeated as well.
    """
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1 + window) for a, b in zip(edge[::2], edge[1::2])]


def duplicate_spans(docs: DataFrame, window: int = 13, seed: int = 5) -> DataFrame:
    """doc_id, row_key, text, words (their number) and spans (start and end in words) for every row."""
    dealt, repeated = duplicate_windows(docs, window, seed)

    def parse(batches):
        words = WordHashes()
        for batch in batches:
            n, spans = [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                split = _split(text)
                n.append(len(split))
                if not found:
                    spans.append([])
                    continue
                of = _runs(_hashes(split, words), window)
                hit = np.zeros(len(of), bool)
                hit[np.frombuffer(found, "<u4")] = True
                spans.append(factors(np.isin(of, of[hit]), window))  # a window can recur within its document
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()),
                 pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "row_key", "text", "words", "spans"])

    joined = dealt.join(repeated, ["doc_id", "row_key"], "left").select("doc_id", "row_key", "text", "found")
    return joined.mapInArrow(parse, "doc_id bigint, row_key bigint, text string, words bigint, spans array<struct<start:int,end:int>>")


def without_duplicates(docs: DataFrame, window: int = 13, seed: int = 5) -> DataFrame:
    """doc_id, text (kept words joined by a space), n_words, n_removed for every row."""
    def cut(batches):
        for batch in batches:
            kept, gone = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                split, at, out = _split(text), 0, []
                for s in spans:  # spans can overlap by less than a window
                    out += split[at:max(at, s["start"])]
                    at = max(at, s["end"])
                out += split[at:]
                kept.append(b" ".join(out).decode("utf-8", "surrogatepass"))
                gone.append(len(split) - len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), batch.column(2), pa.array(gone, pa.int64())],
                                             names=["doc_id", "text", "n_words", "n_removed"])

    spans = duplicate_spans(docs, window, seed).select("doc_id", "text", "words", "spans")
    return spans.mapInArrow(cut, "doc_id bigint, text string, n_words bigint, n_removed bigint")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
