"""Benchmark decontamination: windows of documents within a small edit distance of a benchmark item.

Texts are compared as words: ASCII punctuation is dropped, A-Z is lower case, words are split at ASCII
white space. A document is contaminated by an item of n words if some window of it has a word edit
distance of at most t = floor(``max_edits`` * n) from the item.

1. A window within the distance has ``GRAM`` of the item's words in a row unedited (pigeonhole; where that
   would not follow, as for five words, t is lowered until it does). So only windows that share a run of
   ``GRAM`` words with the item are looked at, at the place where the run would stand in the item.
2. These item-sized windows and the items are embedded by CGK random walks: at every step the current word is
   written, and a hash of step and word decides whether to go on to the next. Words inserted or dropped shift
   the walk only until it synchronises, so edit distance becomes Hamming distance.
   The walks of long texts stay out of step for longer, so items of more than ``PIECE_WORDS`` words are embedded
   in pieces: of a window within the bound, some piece has at most its share of the edits, and so a run of
   ``GRAM`` words of its own.
3. Bit-sampling LSH on the embeddings: a window is a candidate if it agrees with the item, or one of its pieces,
   on all ``SAMPLED`` positions of any table. The number of tables follows from the target recall and the share
   of positions on which a piece at the bound still agrees. Items that may have more edits than that share was
   measured for (``MEASURED_EDITS``), or whose pieces need not keep a run, are verified wherever a run is shared.
4. Candidates are verified by the exact edit distance (Myers' bit-parallel algorithm, the window free to begin
   and end up to t words earlier or later).

The benchmark is the stated query set: it goes to the tasks in blocks of at most ``BLOCK_WORDS`` words, each block
against all documents.

Edge cases: null and empty texts have no words and no match; items of fewer than ``min_words`` words are not
searched for; repeated items and documents match each for itself (the query returns each pair once); null ids are
values; extra columns are ignored; empty tables give an empty result. Whole texts are searched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsplit.llm.common import table
from panelsplit.llm.neardup import WordHashes

GRAM = 3
SAMPLED = 2
#: Independent walks; tables take their positions from one walk each.
WALKS = 8
#: Share of embedded positions on which a window with MEASURED_EDITS agrees with its item of at most PIECE_WORDS words (measured in tests).
AGREEMENT = 0.4
MEASURED_EDITS = 0.2
#: Longer items are embedded in pieces.
PIECE_WORDS = 30
BLOCK_WORDS = 2_000_000
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(None, _PUNCTUATION).split()


def edit_bound(n: int, max_edits: float) -> int:
    """Edits allowed in an item of n words: some GRAM words in a row must stay, whichever words are edited."""
    t = math.floor(max_edits * n + 1e-9)
    while t and math.ceil((n - t) / (t + 1)) < GRAM:
        t -= 1
    return t


def tables_for(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT ** SAMPLED))


def _grams(h: np.ndarray) -> np.ndarray:
    n = len(h) - GRAM + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM if n > 0 else 0):
            out = (out ^ h[i:i + n]) * _ODD
            out ^= out >> np.uint64(32)
    return out


def cgk(rows: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """CGK embedding of rows of word hashes (0 beyond a row's end)."""
    rows = np.concatenate([rows, np.zeros((len(rows), 1), np.uint64)], axis=1)
    at, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
    out = np.empty((len(rows), steps), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(steps):
            out[:, j] = word = rows[every, at]
            key = np.uint64(((walk * 1_000_003 + j) * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) % (1 << 64))
            bit = ((word ^ key) * _ODD) ^ (word >> np.uint64(29))
            go = ((bit * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(np.int64)
            at = np.minimum(at + go, rows.shape[1] - 1)
    return out


def least_edits(item: list, words: list) -> tuple[int, int]:
    """Smallest edit distance of the item from any window of ``words``, and where the first such window ends."""
    n = len(item)
    places: dict = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(words):
        eq = places.get(w, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        hp, hn = down | ~(d0 | up) & full, d0 & up
        score += 1 if hp & top else -1 if hn & top else 0
        hp, hn = hp << 1 & full, hn << 1 & full
        up, down = hn | ~(d0 | hp) & full, d0 & hp
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple], max_edits: float, min_words: int, recall: float, seed: int = 7):
        words = WordHashes()
        split = [(i, [words[w] for w in normal_words(t)]) for i, t in items]
        split = [(i, w) for i, w in split if len(w) >= min_words]
        self.ids = [i for i, _ in split]
        self.words = [np.array(w, np.uint64) for _, w in split]
        self.lists = [w for _, w in split]
        self.bound = np.array([edit_bound(len(w), max_edits) for w in self.words], np.int64)
        self.n = np.array([len(w) for w in self.words], np.int64)
        # Pieces: their item, their first word in it, their words, and whether they need no collision to be verified.
        pieces = [(k, a, w[a:b], sure) for k, w in enumerate(self.words) for a, b, sure in self._cut(k)]
        self.item_of = np.array([x[0] for x in pieces], np.int64)
        self.first = np.array([x[1] for x in pieces], np.int64)
        self.pieces = [x[2] for x in pieces]
        self.piece_n = np.array([len(w) for w in self.pieces], np.int64)
        self.sure = np.array([x[3] for x in pieces], bool)
        grams = [_grams(w) for w in self.pieces]
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        piece, offset = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in
                        ([np.full(len(g), k) for k, g in enumerate(grams)], [np.arange(len(g)) for g in grams]))
        order = np.argsort(gram, kind="stable")
        self.gram, self.piece, self.offset = gram[order], piece[order], offset[order]
        self.maybe = np.zeros(1 << 22, bool)  # a quick no for most runs of words
        self.maybe[(gram >> np.uint64(42)).astype(np.int64)] = True
        rng = np.random.default_rng(seed)
        tables = tables_for(recall)
        self.walk_of = np.arange(tables) % WALKS
        # Positions as shares of the walk over an item; a walk over n words takes 2n steps on average.
        self.places = rng.random((tables, SAMPLED))

    def _cut(self, k: int) -> list[tuple[int, int, bool]]:
        """Pieces (start, end) of item k that are embedded by themselves, or (..., True) to verify without."""
        n, t = int(self.n[k]), int(self.bound[k])
        parts = -(-n // PIECE_WORDS)
        ends = [n * i // parts for i in range(parts + 1)]
        cut = list(zip(ends, ends[1:]))
        kept = [(b - a - t * (b - a) // n, t * (b - a) // n + 1) for a, b in cut]  # words not edited, and the runs they can be in
        if t > MEASURED_EDITS * n + 1e-9 or any(-(-words // runs) < GRAM for words, runs in kept):
            return [(0, n, True)]
        return [(a, b, False) for a, b in cut]

    def steps(self, k: np.ndarray) -> np.ndarray:
        return (1.5 * self.piece_n[k]).astype(np.int64)

    def places_of(self, k: np.ndarray) -> np.ndarray:
        """Sampled positions of every table (axis 1) for the pieces k."""
        return (self.places[None] * self.steps(k)[:, None, None]).astype(np.int64)

    def find(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each text's words, (item, start, end, distance) of the best window of every item that matches.

        The windows of all texts are embedded together."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        sizes = np.array([len(h) for h in texts], np.int64)
        if not len(self.gram) or sizes.sum() < GRAM:
            return out
        h = np.concatenate(texts)
        high = np.cumsum(sizes)
        g = _grams(h)
        at = np.flatnonzero(self.maybe[(g >> np.uint64(42)).astype(np.int64)])
        of = np.searchsorted(high, at, "right")
        whole = at + GRAM <= high[of]
        at, of = at[whole], of[whole]
        left, right = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        many = right - left
        if not many.any():
            return out
        hit = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(np.stack([np.repeat(of, many), self.piece[hit], np.repeat(at, many) - self.offset[hit]], axis=1), axis=0)
        text, piece, start = pairs[:, 0], pairs[:, 1], pairs[:, 2]
        low = high - sizes
        keep = self.sure[piece]
        rest = np.flatnonzero(~keep)
        keep[rest] = self._candidates(h, piece[rest], start[rest], low[text[rest]], high[text[rest]])
        text, item, start = text[keep], self.item_of[piece[keep]], start[keep] - self.first[piece[keep]]
        for d in np.unique(text):
            mine = text == d
            out[d] = self._verified(texts[d], item[mine], start[mine] - low[d])
        return out

    def _candidates(self, h, piece, start, low, high, block: int = 1 << 13):
        """Which windows (from start on, within low and high) collide with their piece of an item in a table."""
        keep = np.zeros(len(piece), bool)
        order = np.argsort(self.piece_n[piece], kind="stable")  # windows of like size are embedded together
        for a in range(0, len(order), block):
            k, s, lo, hi = (x[order[a:a + block]] for x in (piece, start, low, high))
            n = int(self.piece_n[k].max())
            steps = int(1.5 * n) + 1
            at = s[:, None] + np.arange(n)
            inside = (at >= lo[:, None]) & (at < hi[:, None]) & (np.arange(n) < self.piece_n[k][:, None])
            windows = np.where(inside, h[np.clip(at, 0, len(h) - 1)], np.uint64(0))
            # Words before the document's beginning are missing: move the rest to the front.
            for r in np.flatnonzero(s < lo):
                gone = min(n, int(lo[r] - s[r]))
                windows[r] = np.concatenate([windows[r, gone:], np.zeros(gone, np.uint64)])
            which, of = np.unique(k, return_inverse=True)
            rows = np.zeros((len(which), n), np.uint64)
            for r, w in enumerate(which):
                rows[r, :self.piece_n[w]] = self.pieces[w]
            places = self.places_of(k)
            hits = np.zeros(len(k), bool)
            for walk in range(WALKS):
                tables = np.flatnonzero(self.walk_of == walk)
                if len(tables):
                    ours, theirs = cgk(windows, steps, walk), cgk(rows, steps, walk)[of]
                    same = np.take_along_axis(ours == theirs, places[:, tables].reshape(len(k), -1), axis=1)
                    hits |= same.reshape(len(k), len(tables), SAMPLED).all(axis=2).any(axis=1)
            keep[order[a:a + block]] = hits
        return keep

    def _verified(self, h, item, start):
        best: dict[int, tuple[int, int, int]] = {}
        covered: dict[int, int] = {}
        for k, s in sorted(zip(item.tolist(), start.tolist())):
            n, t = int(self.n[k]), int(self.bound[k])
            a, b = max(0, s - t), min(len(h), s + n + t)
            if covered.get(k, -1) >= b:
                continue  # the same words were compared already
            covered[k] = b
            near = h[a:b].tolist()
            d, end = least_edits(self.lists[k], near)
            if d <= t and (k not in best or d < best[k][0]):
                back, length = least_edits(self.lists[k][::-1], near[:end][::-1])
                best[k] = (d, a + end - length, a + end)
        return [(k, a, b, d) for k, (d, a, b) in sorted(best.items())]


_FOUND = "doc_id bigint, text_key bigint, item_id bigint, start int, end int, distance int, item_words int"


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, min_words: int = 5, recall: float = 0.999) -> DataFrame:
    """doc_id, text_key (hash of the text), item_id, start, end (in words), distance, item_words: the best window of
    every document row and item that match."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    words = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()[0][0] // 2
    blocks = math.ceil(max(1, words) / BLOCK_WORDS)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    out = None
    for b in range(blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()]

        def search(batches, block=block):
            found, words_ = Items(block, max_edits, min_words, recall), WordHashes()
            for batch in batches:
                ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
                hashed = [np.fromiter(map(words_.__getitem__, w), np.uint64, len(w)) for w in map(normal_words, texts)]
                hits = [(i, key, found.ids[k], a, e, d, int(found.n[k]))
                        for i, key, windows in zip(ids, keys, found.find(hashed)) for k, a, e, d in windows]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits) if hits else [()] * 7, types)],
                                                 names=["doc_id", "text_key", "item_id", "start", "end", "distance", "item_words"])

        part = rows.mapInArrow(search, _FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that match no item."""
    hits = contaminated_windows(docs, benchmark, **kw).select("doc_id", "text_key").distinct()
    # The row travels as one struct, so that no column of its own can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("r")
    left = rows.join(hits.alias("h"), F.col("r.row.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64("r.row.text") == F.col("h.text_key")), "left_anti")
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key").distinct()
