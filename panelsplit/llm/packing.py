"""Best-fit packing of tokenized documents into sequences, under several capacities at once.

Every document becomes its token ids and an end id; only what is longer than a sequence is cut, into
whole sequences and one shorter first piece. A sequence has three capacities: tokens, documents and
attention cost (the sum of the squared lengths). Pieces are placed longest first; a piece goes to the
open sequence with the best fit, which is the least weighted norm of what would be left of the
capacities, or the largest weighted dot product of piece and residual.

Which bins a piece can go to depends on its length alone, so the packing is planned on the histogram
of lengths (``capacity`` rows at most, however many documents there are): equal bins are kept as one
pattern with a multiplicity. Each piece then finds its sequence by its rank among the pieces of its
length. The ranks come from counts a (salt, length) and a row number within, so that no length, however
frequent, meets in one task. The plan is the same as that of one machine that sees all pieces.

Edge cases: null and empty texts are one end id; repeated rows are packed each for itself; a null
doc_id is packed like others; an empty table gives an empty result; extra columns are ignored. A
capacity that a single piece exceeds raises ValueError.
"""

from __future__ import annotations

import sys
import types
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsplit.llm.common import shuffle_partitions, store, table

#: Fixed value: how a byte-level BPE of this family parts a text before merging (the ``use_regex`` of its pre-tokenizer).
_PARTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def _worker_cache() -> types.ModuleType:
    """A place that lives as long as the Python worker, so that its tasks share one encoder."""
    return sys.modules.setdefault("_panelsplit_worker_cache", types.ModuleType("_panelsplit_worker_cache"))


class Encoder:
    """Token ids of whole texts by a byte-level BPE tokenizer file, its special tokens included.

    Vocabulary and merges of the file are given to tiktoken's merge loop, which takes a quarter of the time for words that it
    has not met; this needs a vocabulary whose ids follow the order of the merges, and is refused otherwise. Ids are
    those of the ``tokenizers`` library (tests compare them, over all code points as well).
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, steps = made["model"], made["pre_tokenizer"]
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        byte_of = _byte_of()
        ids = {t: i for t, i in model["vocab"].items() if t not in special}
        merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        plain = steps["type"] == "ByteLevel" and not steps["add_prefix_space"] and not made["normalizer"]
        if not plain or any(a >= b for a, b in zip(merged, merged[1:])) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
            raise ValueError(f"{path} is no plain byte-level BPE with ids in the order of its merges")
        self.special = set(special)
        self.core = tiktoken.Encoding(path, pat_str=_PARTS, mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in ids.items()}, special_tokens=special)._core_bpe

    @classmethod
    def of_worker(cls, path: str) -> "Encoder":
        cache = _worker_cache().__dict__
        if path not in cache:
            cache[path] = cls(path)
        return cache[path]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return np.frombuffer(self.core.encode_to_tiktoken_buffer(text, self.special), "=u4").astype("<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    def run(batches):
        encoder = Encoder.of_worker(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 512):
                rows = []
                for doc_id, text in zip(ids[at:at + 512], texts[at:at + 512]):
                    raw = encoder.encode(text or "") + end
                    n = len(raw) // 4
                    start, piece = 0, 0
                    while start < n:
                        stop = start + ((n % capacity or capacity) if piece == 0 else capacity)
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(raw[4 * start:4 * stop])))
                        start, piece = stop, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Capacities(NamedTuple):
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024


class Slot(NamedTuple):
    """Pieces of one length with ranks from ``rank`` on, one in each of ``bins`` sequences from ``sequence`` on, at ``offset``."""
    length: int
    rank: int
    sequence: int
    offset: int
    bins: int


def plan_packing(histogram: dict[int, int], capacities: Capacities = Capacities(), weights=(1.0, 0.05, 0.05), fit: str = "norm") -> list[Slot]:
    """Vector best fit, longest first, over the numbers of pieces by length."""
    cap = np.array(capacities, float)
    w = np.array(weights) / cap ** 2
    residual = np.zeros((0, 3))
    bins: list[int] = []
    patterns: list[list[int]] = []
    slots: list[tuple[int, int]] = []  # (bins, pattern) closed: nothing more fits
    smallest = min(histogram, default=0)

    def put(k: int, item: np.ndarray, length: int, n: int):
        """One more piece in n bins of group k, which splits if it has more."""
        nonlocal residual
        if bins[k] > n:
            bins[k] -= n
            bins.append(n)
            patterns.append([*patterns[k], length])
            residual = np.vstack([residual, residual[k] - item])
        else:
            patterns[k] = [*patterns[k], length]
            residual[k] -= item

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        item = np.array([length, 1, length * length], float)
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {capacities}")
        per_bin = int((cap // item).min())
        while n:
            fits = np.flatnonzero((residual >= item).all(axis=1)) if len(bins) else []
            if len(fits):
                left = residual[fits] - item
                score = -(left ** 2 @ w) if fit == "norm" else residual[fits] @ (w * item)
                k = int(fits[score.argmax()])
                took = min(n, bins[k])
                put(k, item, length, took)
            else:
                here = min(per_bin, n)
                took = n // here * here
                bins.append(n // here)
                patterns.append([length] * here)
                residual = np.vstack([residual, cap - here * item])
            n -= took
        # What can't take the smallest piece is closed.
        least = np.array([smallest, 1, smallest * smallest], float)
        open_ = (residual >= least).all(axis=1)
        if not open_.all():
            slots += [(bins[k], tuple(patterns[k])) for k in np.flatnonzero(~open_)]
            bins, patterns, residual = [bins[k] for k in np.flatnonzero(open_)], [patterns[k] for k in np.flatnonzero(open_)], residual[open_]
    slots += [(b, tuple(p)) for b, p in zip(bins, patterns)]
    plan, sequence, ranks = [], 0, dict.fromkeys(histogram, 0)
    for number, pattern in slots:
        offset = 0
        for length in pattern:
            plan.append(Slot(length, ranks[length], sequence, offset, number))
            ranks[length] += number
            offset += length
        sequence += number
    return plan


def pack(pieces: DataFrame, capacities: Capacities = Capacities(), weights=(1.0, 0.05, 0.05), fit: str = "norm") -> DataFrame:
    """``pieces`` (a stored table) with sequence_id and offset."""
    spark = pieces.sparkSession
    salts = max(8, shuffle_partitions(spark))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("salt", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(plan_packing(histogram, capacities, weights, fit))
    before = counts.select("salt", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("salt", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (salted.withColumn("nth", nth).join(before, ["salt", "length"])
              .withColumn("rank", F.col("before") + F.col("nth")).select(*pieces.columns, "rank"))
    lengths, first, sequence, offset = (np.array([s[i] for s in plan], np.int64) for i in range(4))
    bits = 40  # a rank is below 2 ** 40: 10 ** 12 pieces of one length

    def place(batches):
        keys = (lengths << bits) + first
        for batch in batches:
            n = batch.num_columns - 1
            length, rank = batch.column(batch.schema.names.index("length")).to_numpy(), batch.column(n).to_numpy()
            k = np.searchsorted(keys, (length << bits) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array(sequence[k] + rank - first[k]), pa.array(offset[k])],
                names=batch.schema.names[:n] + ["sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields), "sequence_id bigint, offset bigint"])
    return ranked.mapInArrow(place, schema)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacities: Capacities = Capacities(), end_id: int = 2) -> DataFrame:
    pieces = store(token_pieces(docs, str(tokenizer or default_tokenizer()), end_id, capacities.tokens), "pieces")
    return pack(pieces, capacities)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
