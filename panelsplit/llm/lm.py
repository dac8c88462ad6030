"""Language-model scores: context-tree weighting over bytes, beside a smoothed unigram base.

The text is its words (runs of characters other than ASCII white space, A-Z in lower case) joined by one
space, and an end. The model predicts it byte by byte, a byte by eight binary decisions. For every context
of 0 to ``depth`` bytes and every beginning of the next byte's bits there is a node with the counts of
zeros and ones met in training; it estimates by Krichevsky and Trofimov. Context-tree weighting mixes the
estimates of all depths: a node's weighted probability is half its own block probability and half the
product of its children's, so the weight of stopping at a node follows from the counts. Where a longer
context was not met in training, the tree ends. The prediction of every bit is a proper distribution.

Training counts byte strings of ``depth + 1`` over all training rows (every task sends its counts) into
blocks of the contexts' nearest two bytes. A block holds the whole tree below depth 2; what depths 0 and 1
need of it is summed by Spark, so the driver sees at most 65,536 strings and their nodes. The tree is as deep
for any size of the input, and never in one place: documents are dealt into chunks of about ``FLUSH_BYTES``,
a chunk asks each block for the probabilities of its distinct strings, and what comes back is summed by
document where the chunk's texts are. A block that holds more of the training text than the mean is copied
as many times, so that a frequent pair of bytes is not answered by one task.

Unigram counts cover all training tokens. Tokens with at least 1 / 65,536 of all occurrences (so there
are at most 65,536) are looked up in every task; the others are asked for, once a chunk, in blocks by hash. Tokens are told apart by 64-bit hashes.

Edge cases: a null text is an empty one (only the end); a null doc_id is neither learned from nor held
out; equal rows count each in training and get equal scores; without training rows every bit is 1/2 and
the base is 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsplit.llm.common import id_remainder, shuffle_partitions, store, table
from panelsplit.llm.neardup import WordHashes

#: Bytes of text, and words, that a task handles at a time.
FLUSH_BYTES = 6 << 20
FLUSH_WORDS = 1 << 21
#: Strings of a block whose trees are built together (more if one pair of nearest bytes has more).
PIECE = 1 << 18
#: Tokens of at least this share of all occurrences are broadcast.
FREQUENT_SHARE = 1 / 65536
END = 0x0A
_END_TOKEN = xxhash.xxh3_64_intdigest(b"")  # no word is empty


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# ---------------------------------------------------------------- unigrams

def _token_hashes(split: list[bytes], words: WordHashes) -> np.ndarray:
    return np.fromiter([*map(words.__getitem__, split), _END_TOKEN], np.uint64, len(split) + 1)


def _block_of(values: np.ndarray, blocks: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((values * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)) % np.uint64(blocks)


_COUNTS = "block int, keys binary, counts binary"
_COUNTS_ARROW = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _packed_counts(keys: np.ndarray, counts: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(block, kind="stable")
    keys, counts, block = keys[order], counts[order], block[order]
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
    rows = [(int(block[a]), keys[a:b].astype("<u8").tobytes(), counts[a:b].astype("<i8").tobytes()) for a, b in zip(at, [*at[1:], len(block)])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, _COUNTS_ARROW.types)], schema=_COUNTS_ARROW)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, sorted (``np.unique`` hashes them, which takes longer than sorting numbers)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _sum_block(block: pa.Table) -> pa.Table:
    keys, counts = _added([np.frombuffer(x, "<u8") for x in block.column("keys").to_pylist()], [np.frombuffer(x, "<i8") for x in block.column("counts").to_pylist()])
    return pa.table({"block": pa.array([block.column("block")[0].as_py()], pa.int32()), "keys": [keys.tobytes()], "counts": [counts.tobytes()],
                     "distinct": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})


_SUMS = _COUNTS + ", distinct bigint, total bigint"


def token_counts(training: DataFrame, blocks: int) -> DataFrame:
    """One row a block: the block's distinct token hashes and their counts, packed."""
    def count(batches):
        words, held, n = WordHashes(), [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _packed_counts(keys, counts, _block_of(keys, blocks))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(_token_hashes(_words(text), words))
                n += len(held[-1])
                if n >= FLUSH_WORDS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return training.select("text").mapInArrow(count, _COUNTS).groupBy("block").applyInArrow(_sum_block, _SUMS)


def _frequent(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    def pick(batches):
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k, c = np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(k[c >= least].astype(np.int64)), pa.array(c[c >= least])], names=["key", "n"])

    got = counts.select("keys", "counts").mapInArrow(pick, "key bigint, n bigint").toPandas()
    k, c = got["key"].to_numpy(np.int64).astype(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(k)
    return k[order], c[order]


def _lookup(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of the wanted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


# ---------------------------------------------------------------- context trees

def _strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (context, nearest byte first, then the byte) of all positions of the texts; where each text's keys begin and how many it has."""
    pad = bytes([END]) * depth
    raw = np.frombuffer(b"".join(pad + t for t in texts) + pad, np.uint8).astype(np.uint64)
    n = len(raw) - depth
    key = raw[depth:].copy()
    for d in range(1, depth + 1):  # the byte d places before
        key |= raw[depth - d:depth - d + n] << np.uint64(8 * (depth - d + 1))
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + depth)[:-1]]).astype(np.int64)
    inside = np.zeros(len(key) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths, -1)
    return key[np.cumsum(inside[:-1]) > 0], np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths


def _text(text: str | None) -> bytes:
    return b" ".join(_words(text)) + bytes([END])


def string_counts(training: DataFrame, depth: int, blocks: int) -> DataFrame:
    """One row a block of contexts (by their nearest two bytes): distinct strings and their counts, packed."""
    def count(batches):
        held, n = [], 0

        def flush():
            keys = np.sort(_strings(held, depth)[0])
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            near = keys[at] >> np.uint64(8 * max(0, depth - 2) + 8)
            return _packed_counts(keys[at], np.diff(np.append(at, len(keys))), _block_of(near, blocks))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(_text(text))
                n += len(held[-1])
                if n >= FLUSH_BYTES:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return training.select("text").mapInArrow(count, _COUNTS).groupBy("block").applyInArrow(_sum_block, _SUMS)


class _Level(NamedTuple):
    """Nodes of one depth and one number of known bits: sorted keys (context, then the bits behind a leading 1) and counts."""
    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray

    def one(self):
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)

    def log_block(self):
        return _lgamma_half(self.zeros) + _lgamma_half(self.ones) - _lgamma_one(self.zeros + self.ones)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0 (Stirling's series after a shift to x >= 8)."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1)), shift)
        y = np.where(low, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - shift


def _lgamma_half(n):
    return _lgamma(n + 0.5) - 0.5 * math.log(math.pi)


def _lgamma_one(n):
    return _lgamma(n + 1.0)


def _levels(keys: np.ndarray, counts: np.ndarray) -> list[_Level]:
    """The nodes for 0 to 7 known bits of sorted (context, byte) keys."""
    out = []
    context, byte = keys >> np.uint64(8) << np.uint64(8), keys & np.uint64(255)
    for j in range(8):
        node = context | (np.uint64(1 << j) | (byte >> np.uint64(8 - j)))
        bit = (byte >> np.uint64(7 - j)) & np.uint64(1)
        at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        ones, both = (np.add.reduceat(x, at) if len(at) else np.zeros(0, np.int64) for x in (counts * bit.astype(np.int64), counts))
        out.append(_Level(node[at], both - ones, ones))
    return out


def _shorter(keys: np.ndarray, counts: np.ndarray, by: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The strings without the farthest ``by`` bytes of context."""
    return _added([(keys >> np.uint64(8 * by + 8) << np.uint64(8)) | (keys & np.uint64(255))], [counts])


def _parent(nodes: np.ndarray) -> np.ndarray:
    return (nodes >> np.uint64(16) << np.uint64(8)) | (nodes & np.uint64(255))


def _weighted(level: _Level, below: _Level | None, log_below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of the nodes, and the weight of stopping there."""
    own = level.log_block()
    if below is None:
        return own, np.ones(len(own))
    return _halves(own, np.bincount(np.searchsorted(level.key, _parent(below.key)), log_below, len(level.key)))


def _halves(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.logaddexp(own, children) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


class _Mixed(NamedTuple):
    """What the depths above give a node: P(bit = 1) = above + rest * (estimate from here on)."""
    key: np.ndarray
    above: np.ndarray
    rest: np.ndarray


def _table(keys: np.ndarray, levels: list[_Level], mixed: list[_Mixed]) -> np.ndarray:
    """For every (context, byte) the probabilities of its eight bits if the tree ends at this depth.

    Where a bit is likelier than its opposite, minus the opposite's probability stands for it: in 32 bits, the first
    would be 1 after some ten million counts, and the opposite impossible."""
    out = np.empty((len(keys), 8), "<f4")
    context, byte = keys >> np.uint64(8) << np.uint64(8), keys & np.uint64(255)
    for j in range(8):
        at = np.searchsorted(levels[j].key, context | (np.uint64(1 << j) | (byte >> np.uint64(8 - j))))
        one = (mixed[j].above + mixed[j].rest * levels[j].one())[at]
        p = np.where((byte >> np.uint64(7 - j)) & np.uint64(1) == 1, one, 1 - one)
        out[:, j] = np.where(p <= 0.5, p, p - 1)
    return out


def _next_mixed(levels: list[_Level], mixed: list[_Mixed], stop: list[np.ndarray], below: list[_Level]) -> list[_Mixed]:
    out = []
    for j in range(8):
        at = np.searchsorted(levels[j].key, _parent(below[j].key))
        above = mixed[j].above + mixed[j].rest * stop[j] * levels[j].one()
        out.append(_Mixed(below[j].key, above[at], (mixed[j].rest * (1 - stop[j]))[at]))
    return out


def _tree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
    """Strings, levels, log weighted probabilities and stop weights of depths ``depth`` down to ``top``."""
    tables, levels, logs, stops = {}, {}, {}, {}
    for d in range(depth, top - 1, -1):
        tables[d] = (keys, counts) if d == depth else _shorter(*tables[d + 1])
        levels[d] = _levels(*tables[d])
        both = [_weighted(levels[d][j], levels[d + 1][j] if d < depth else None, logs[d + 1][j] if d < depth else None) for j in range(8)]
        logs[d], stops[d] = [b[0] for b in both], [b[1] for b in both]
    return tables, levels, logs, stops


class ByteTree(NamedTuple):
    """By depth: sorted (context, byte) keys and the probabilities of the byte's bits, as ``_table`` writes them."""
    depth: int
    keys: list[np.ndarray]
    bits: list[np.ndarray]


class _Upper(NamedTuple):
    """Depths 0 and 1: their tables, and the levels, mixtures and stop weights of depth 1."""
    keys: list[np.ndarray]
    bits: list[np.ndarray]
    levels: list[_Level]
    mixed: list[_Mixed]
    stops: list[np.ndarray]


def _pieces(keys: np.ndarray, counts: np.ndarray, depth: int):
    """Parts of a block's sorted strings, cut where the nearest two bytes change."""
    near = keys >> np.uint64(8 * (depth - 2) + 8)
    cuts = np.append(np.flatnonzero(near[1:] != near[:-1]) + 1, len(keys))
    at = 0
    while at < len(keys):
        end = int(cuts[min(np.searchsorted(cuts, at + PIECE), len(cuts) - 1)])
        yield keys[at:end], counts[at:end]
        at = end


def _counted(batches):
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")


def _upper_tree(counted: DataFrame, depth: int) -> _Upper:
    """Depths 0 and 1 of the tree of ``counted`` strings: blocks send sums for the nodes of depth 1."""
    strings = 8  # the level that stands for whole strings

    def sums(batches):
        for block in _counted(batches):
            for keys, counts in _pieces(*block, depth):
                tables, levels, logs, _ = _tree(keys, counts, depth, 2)
                key, n = _shorter(*tables[2])
                parts = [(np.full(len(key), strings), key, n, np.zeros(len(key)))]
                for j in range(8):
                    parent, of = np.unique(_parent(levels[2][j].key), return_inverse=True)
                    parts.append((np.full(len(parent), j), parent, np.zeros(len(parent), np.int64), np.bincount(of, logs[2][j], len(parent))))
                level, key, n, log = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(key.astype(np.int64)), pa.array(n, pa.int64()), pa.array(log, pa.float64())], names=["level", "key", "n", "log"])

    rows = (counted.select("keys", "counts").mapInArrow(sums, "level int, key bigint, n bigint, log double")
            .groupBy("level", "key").agg(F.sum("n").alias("n"), F.sum("log").alias("log")).toPandas().sort_values(["level", "key"]))
    level, key, n, log = (rows[c].to_numpy(t) for c, t in (("level", np.int64), ("key", np.int64), ("n", np.int64), ("log", float)))
    ones = key[level == strings].astype(np.uint64), n[level == strings]
    zeros = _shorter(*ones) if len(ones[0]) else ones
    levels, above = _levels(*ones), _levels(*zeros)
    both = [_halves(levels[j].log_block(), log[level == j]) for j in range(8)]
    top = [_weighted(above[j], levels[j], both[j][0]) for j in range(8)]
    mixed = [_Mixed(x.key, np.zeros(len(x.key)), np.ones(len(x.key))) for x in above]
    next_ = _next_mixed(above, mixed, [t[1] for t in top], levels)
    return _Upper([zeros[0], ones[0]], [_table(zeros[0], above, mixed), _table(ones[0], levels, next_)], levels, next_, [b[1] for b in both])


def _piece_tree(keys: np.ndarray, counts: np.ndarray, depth: int, upper: _Upper) -> ByteTree:
    """The tree of a piece of a block, with depths 0 and 1 of all."""
    tables, levels, _, stops = _tree(keys, counts, depth, 2)
    mixed = _next_mixed(upper.levels, upper.mixed, upper.stops, levels[2])
    bits = list(upper.bits)
    for d in range(2, depth + 1):
        bits.append(_table(tables[d][0], levels[d], mixed))
        if d < depth:
            mixed = _next_mixed(levels[d], mixed, stops[d], levels[d + 1])
    return ByteTree(depth, [*upper.keys, *(tables[d][0] for d in range(2, depth + 1))], bits)


def fit_tree(training: DataFrame, depth: int = 5, max_strings: int = 8_000_000) -> ByteTree:
    """Context-tree model of the texts of ``training``, whole on the driver, for looking into a small model.

    Scoring does not use it. The depth falls until at most ``max_strings`` strings are held.
    """
    blocks = shuffle_partitions(training.sparkSession)
    full = depth
    counted = store(string_counts(training, full, blocks), "strings")

    def sizes(batches):
        for k, c in _counted(batches):
            found = [len(k)] + [len(_shorter(k, c, by)[0]) for by in range(1, full - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(full, full - len(found), -1), pa.int32()), pa.array(found, pa.int64())], names=["depth", "n"])

    held = dict(counted.select("keys", "counts").mapInArrow(sizes, "depth int, n bigint").groupBy("depth").agg(F.sum("n")).collect())
    while depth > 2 and sum(n for d, n in held.items() if d <= depth) > max_strings:
        depth -= 1
    if depth < full:
        counted = store(string_counts(training, depth, blocks), "strings")
    upper = _upper_tree(counted, depth)
    parts = [_piece_tree(np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["counts"], "<i8"), depth, upper) for r in counted.select("keys", "counts").collect()]
    keys, bits = list(upper.keys), list(upper.bits)
    for d in range(2, depth + 1):
        k = np.concatenate([t.keys[d] for t in parts] or [np.zeros(0, np.uint64)])
        order = np.argsort(k)
        keys.append(k[order])
        bits.append(np.concatenate([t.bits[d] for t in parts] or [np.zeros((0, 8), "<f4")])[order])
    return ByteTree(depth, keys, bits)


def log10_probabilities(tree: ByteTree, keys: np.ndarray) -> np.ndarray:
    """log10 P(byte | context) of distinct strings.

    From the longest context on: the bits that the context has met follow its table (a byte it has not met
    shares its first bits with a neighbour in the table and then turns off); from there the next shorter
    context goes on, and where none has met the bits, they are 1/2 each.
    """
    out = np.zeros(len(keys))
    known = np.zeros(len(keys), np.int64)  # bits that are predicted
    for d in range(tree.depth, -1, -1):
        todo = np.flatnonzero(known < 8)
        if not len(todo) or not len(tree.keys[d]):
            continue
        wanted = keys[todo] >> np.uint64(8 * (tree.depth - d) + 8) << np.uint64(8) | (keys[todo] & np.uint64(255))
        table, bits = tree.keys[d], tree.bits[d]
        right = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        left = np.maximum(right - 1, 0)
        shared, near = np.full(len(todo), -1), np.zeros(len(todo), np.int64)
        for at in (right, left):  # the neighbour with the longest common beginning
            same = table[at] >> np.uint64(8) == wanted >> np.uint64(8)
            diff = ((table[at] ^ wanted) & np.uint64(255)).astype(np.int64)
            common = np.where(same, 8 - np.frexp(diff)[1], -1)
            better = common > shared
            shared, near = np.where(better, common, shared), np.where(better, at, near)
        for j in range(8):
            here = (known[todo] <= j) & (j <= shared)
            if here.any():
                p = bits[near[here], j].astype(float)
                out[todo[here]] += np.log10(np.where((shared[here] > j) == (p > 0), abs(p), 1 - abs(p)))
        known[todo] = np.maximum(known[todo], np.minimum(shared + 1, 8))
    return out + (8 - known) * math.log10(0.5)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte (first all lowest bytes), which compresses well."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _by_block(block: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The blocks of keys, and which keys are in each."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
    return [(int(block[a]), order[a:b]) for a, b in zip(at, [*at[1:], len(block)])]


_CHUNKS = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("has_id", pa.binary()), ("held_out", pa.binary()), ("lengths", pa.binary()), ("text", pa.binary())])


def _deal(batches):
    """mapInArrow body over (doc_id, held_out, text): chunks of about FLUSH_BYTES, a row each."""
    held, size = [], 0

    def flush():
        lengths = np.array([len(r[2]) for r in held], "<i8")
        row = (uuid.uuid4().int >> 65, np.array([r[0] or 0 for r in held], "<i8").tobytes(), np.array([r[0] is not None for r in held]).tobytes(),
               np.array([r[1] for r in held], bool).tobytes(), lengths.tobytes(), pa.compress(b"".join(r[2] for r in held), codec="zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNKS)], schema=_CHUNKS)

    for batch in batches:
        for doc_id, out, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            held.append((doc_id, out, _text(text)))
            size += len(held[-1][2])
            if size >= FLUSH_BYTES:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _texts_of(lengths: bytes, text: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, "<i8")).tolist()
    raw = pa.decompress(text, decompressed_size=ends[-1], codec="zstd", asbytes=True)
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _scored(chunks: DataFrame, tokens: DataFrame, frequent: tuple[np.ndarray, np.ndarray], unit: float, strings: DataFrame, depth: int, blocks: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of all rows in ``chunks``, by the counts of tokens and strings."""
    upper = _upper_tree(strings, depth)
    shift = np.uint64(8 * (depth - 2) + 8)
    whole = strings.agg(F.coalesce(F.sum("total"), F.lit(0))).collect()[0][0]
    copied = strings.select("block", "keys", "counts", F.greatest(F.lit(1), F.round(F.col("total") * blocks / F.lit(max(1, whole)))).cast("int").alias("copies"))
    copies = {r["block"]: r["copies"] for r in copied.select("block", "copies").where("copies > 1").collect()}
    # Blocks of tokens are numbered behind those of strings.
    known = (copied.select("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "keys", "counts")
             .unionByName(tokens.select((F.col("block") + blocks).alias("block"), F.lit(0).alias("copy"), "keys", "counts")))

    def rare_of(texts, words):
        """Every text's tokens (as indices of the distinct ones), the distinct ones, their counts if frequent, and which are rare."""
        hashes = [_token_hashes(t.split(), words) for t in texts]
        value, of = np.unique(np.concatenate(hashes), return_inverse=True)
        often = _lookup(*frequent, value)
        return [len(h) for h in hashes], value, of, often, np.flatnonzero(often == 0)

    def ask(batches):
        words = WordHashes()
        for batch in batches:
            for chunk, lengths, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                texts = _texts_of(lengths, text)
                keys = _distinct(_strings(texts, depth)[0])
                parts = [(b, chunk % copies.get(b, 1), keys[x]) for b, x in _by_block(_block_of(keys >> shift, blocks))]
                _, value, _, _, rare = rare_of(texts, words)
                parts += [(blocks + b, 0, value[rare[x]]) for b, x in _by_block(_block_of(value[rare], blocks))]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], pa.int32()), pa.array([x[1] for x in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()),
                                                  pa.array([_packed_keys(x[2]) for x in parts], pa.binary())], names=["block", "copy", "chunk", "asked"])

    def logs_of(distinct, keys, counts):
        out, at, none = np.empty(len(distinct), "<f8"), 0, np.zeros(0, np.uint64)
        for piece in _pieces(keys, counts, depth):
            end = int(np.searchsorted(distinct >> shift, piece[0][-1] >> shift, "right"))
            if end > at:
                out[at:end] = log10_probabilities(_piece_tree(*piece, depth, upper), distinct[at:end])
            at = end
        if at < len(distinct):  # behind the last pair of bytes that was met
            out[at:] = log10_probabilities(ByteTree(depth, [*upper.keys, *[none] * (depth - 1)], [*upper.bits, *[np.zeros((0, 8), "<f4")] * (depth - 1)]), distinct[at:])
        return out

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        wanted = [_unpacked_keys(x) for x in asked.column("asked").to_pylist()]
        keys, counts = (np.frombuffer(table.column(c)[0].as_py() if len(table) else b"", t) for c, t in (("keys", "<u8"), ("counts", "<i8")))
        if wanted and asked.column("block")[0].as_py() >= blocks:
            found = [_lookup(keys, counts, w).astype("<i8") for w in wanted]
        elif wanted:
            distinct = _distinct(np.concatenate(wanted))
            logs = logs_of(distinct, keys, counts)
            found = [logs[np.searchsorted(distinct, w)] for w in wanted]
        else:
            found = []
        return pa.table({"block": asked.column("block"), "chunk": asked.column("chunk"), "found": pa.array([x.tobytes() for x in found], pa.binary())})

    def add(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        texts = _texts_of(row["lengths"], row["text"])
        found = dict(zip(answers.column("block").to_pylist(), answers.column("found").to_pylist()))
        n, value, of, count, rare = rare_of(texts, WordHashes())
        for b, x in _by_block(_block_of(value[rare], blocks)):
            count[rare[x]] = np.frombuffer(found[blocks + b], "<i8")
        first = np.cumsum([0, *n[:-1]])
        base, seen = np.add.reduceat((np.log10(count + 0.5) - unit)[of], first), np.add.reduceat((count > 0).astype(np.int64)[of], first)
        keys, starts, _ = _strings(texts, depth)
        which, keys = pd.factorize(keys)
        order = np.argsort(keys)  # as they were asked for
        answered = np.empty(len(keys))
        for b, x in _by_block(_block_of(keys[order] >> shift, blocks)):
            answered[order[x]] = np.frombuffer(found[b], "<f8")
        logs = answered[which]
        return pa.table({"doc_id": pa.array(np.frombuffer(row["ids"], "<i8"), mask=~np.frombuffer(row["has_id"], bool)), "held_out": pa.array(np.frombuffer(row["held_out"], bool)),
                         "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(seen), "base_score": pa.array(base), "score": pa.array(np.add.reduceat(logs, starts))})

    asked = chunks.select("chunk", "lengths", "text").mapInArrow(ask, "block int, copy int, chunk bigint, asked binary")
    answers = asked.groupBy("block", "copy").cogroup(known.groupBy("block", "copy")).applyInArrow(answer, "block int, chunk bigint, found binary")
    return (chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(add, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"))


def score_documents(docs: DataFrame, training: Column, held_out: Column, depth: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; the model learns from the rows where ``training`` holds."""
    blocks = shuffle_partitions(docs.sparkSession)
    learned = docs.where(training)
    counts = store(token_counts(learned, blocks), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).collect()[0]
    frequent = _frequent(counts, max(1, total * FREQUENT_SHARE))
    unit = math.log10(total + 0.5 * (distinct + 1))
    strings = store(string_counts(learned, depth, blocks), "strings")
    # Stored, as a chunk must hold the same rows whenever it is read.
    chunks = store(docs.select("doc_id", F.coalesce(held_out, F.lit(False)), "text").mapInArrow(_deal, "chunk bigint, ids binary, has_id binary, held_out binary, lengths binary, text binary"), "chunks")
    scored = _scored(chunks, counts, frequent, unit, strings, depth, blocks)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


#: Rows with this remainder of crc32 modulo 5 are held out.
HELD_OUT = 1


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    remainder = id_remainder("doc_id", 5)
    return score_documents(table(spark, sf_dir, "documents"), remainder != HELD_OUT, remainder == HELD_OUT)
