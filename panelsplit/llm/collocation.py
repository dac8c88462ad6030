r"""Phrase collocations per language, counted on a prefix-free parse.

1. **Parse.** A document is a sequence of tokens: its words, and a mark at each break between pieces. A window of
   ``WINDOW`` tokens whose hash is 0 modulo ``PERIOD`` is a trigger; chunks run from one trigger to the next and include
   both. As the text alone decides where chunks begin, passages that recur are cut alike: the distinct chunks of
   a language are the dictionary, with the number of times each occurs in the parse.
2. **Counts.** n-grams are counted inside the distinct chunks and weighted by the chunk's frequency. Neighbouring
   chunks overlap by a window, so an n-gram of at most ``WINDOW`` + 1 words lies whole in the chunk that holds its start
   before the chunk's last window; only there it is counted, so that overlaps count once. Counts are combined within a
   task, then summed by (language, phrase).
3. **Longer ones.** Words and pairs come first. A longer phrase has to consist of frequent pairs, so the second
   pass counts 3- and 4-word phrases whose pairs are all marked in a bitmap of ``BITS`` bits (a hash of language and
   pair; a collision costs work, not rightness). The bitmap is all that is sent out; its size is fixed.
4. **Scores.** A phrase's cuts look up the counts of their two parts by joins; the part of a longer phrase is at
   least as frequent as the phrase, so it is among the frequent ones. Arithmetic is in decimals and whole division.

No n-gram is left out but for having too low a count. The last step keeps the first ``top`` phrases a language, which is
the report's size; tasks cut their own rows to that before they are brought together.

Edge cases: a null text is an empty one and has no words; a null lang is ``und``, together with rows whose lang is that
text; rows that share a doc_id, repeated rows and null doc_ids all count, each for itself; texts are parsed whole; ties in the
score go to the more frequent phrase, then to the smaller one in UTF-8 byte order; of cuts with the same score the one with
the shortest first part counts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsplit.llm.common import store, table

#: Tokens of a trigger window, and so of the overlap of two chunks; phrases have one word more at most.
WINDOW = 3
#: A window in so many is a trigger.
PERIOD = 48
#: Bits of the map of frequent pairs (8 MB).
BITS = 1 << 26
#: Tokens whose numbers or hashes a task keeps, and bytes of chunks that it counts together before it hands them on.
HELD = 400_000
HELD_BYTES = 8 << 20

_BREAK = b"\n"
_BREAKS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]+")


class _Hashes(dict):
    """Hashes of tokens; forgets when it holds many."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token)
        return h


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), with a break mark between pieces that have words."""
    out: list[bytes] = []
    for piece in _BREAKS.split((text or "").encode("utf-8", "surrogatepass").lower()):
        words = [w for w in piece.replace(b"\t", b" ").split(b" ") if w]
        if words:
            out += words
            out.append(_BREAK)
    return out[:-1]


def chunks(of: list[bytes], hashes: dict) -> list[tuple[bytes, int]]:
    """(tokens joined by a blank, number of places where an n-gram counts) of every chunk."""
    n = len(of)
    if not n:
        return []
    starts = [0]
    if n > WINDOW:
        h = np.fromiter(map(hashes.__getitem__, of), np.uint64, n)
        mixed = np.zeros(n - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            mixed = (mixed ^ h[i:n - WINDOW + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        # A trigger at the very end would leave a chunk of a window alone.
        at = np.flatnonzero(mixed[1:-1] % np.uint64(PERIOD) == 0) + 1
        starts += at.tolist()
    ends = starts[1:]
    return [*((b" ".join(of[a:b + WINDOW]), b - a) for a, b in zip(starts, ends)), (b" ".join(of[starts[-1]:]), n - starts[-1])]


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary: lang, chunk (binary), places and frequency of every distinct chunk."""
    def run(batches):
        hashes, found = _Hashes(), Counter()

        def rows():
            keys = list(found)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.int64()),
                 pa.array(list(found.values()), pa.int64())], names=["lang", "chunk", "places", "frequency"])
            found.clear()
            return out

        for batch in batches:
            held = 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for chunk, places in chunks(tokens(text), hashes):
                    found[lang, chunk, places] += 1
                held += len(text or "")
                if len(found) > HELD // 10 or held > 1 << 25:
                    yield rows()
                    held = 0
        yield rows()

    schema = "lang string, chunk binary, places bigint, frequency bigint"
    parsed = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, schema)
    return parsed.groupBy("lang", "chunk", "places").agg(F.sum("frequency").alias("frequency"))


class _Batch:
    """Chunks of one language as arrays: word numbers, weights, and at which places n-grams of 1 and 2 words count."""

    def __init__(self, chunks_: list[bytes], places: list[int], weights: list[int], numbers: "_Numbers"):
        of = b" ".join(chunks_).split(b" ")
        lengths = np.fromiter((c.count(b" ") + 1 for c in chunks_), np.int64, len(chunks_))
        n = len(of)
        self.ids = np.fromiter(map(numbers.__getitem__, of), np.int64, n)
        self.weights = np.repeat(np.array(weights, np.int64), lengths)
        ends = np.cumsum(lengths)
        place = np.arange(n) - np.repeat(ends - lengths, lengths)
        word = self.ids != numbers[_BREAK]
        last = np.zeros(n, bool)
        last[ends - 1] = True
        self.starts = (place < np.repeat(np.array(places, np.int64), lengths)) & word
        follows = word & ~last
        follows[:-1] &= word[1:]
        #: Whether a word and another follow each other within the chunk.
        self.pair = follows[:-1]


class _Numbers(dict):
    """Numbers of tokens, in the order in which they are met."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, token: bytes) -> int:
        self[token] = len(self.words)
        self.words.append(token)
        return len(self.words) - 1


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of every distinct key, and the sum of its weights."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return order[first], np.add.reduceat(weights[order], first)


def _counted(dictionary: DataFrame, grams) -> DataFrame:
    """lang, phrase, words and f: sums of what ``grams(batch, lang, numbers)`` yields within tasks: (n, places, keys), the places
    where n-grams start and a key for each that is equal where the n-grams are. Tasks hold ``HELD_BYTES`` of chunks at a time."""
    def run(batches):
        numbers = _Numbers()
        held: dict[str, tuple[list, list, list]] = {}
        size = 0

        def rows():
            nonlocal numbers, size
            for lang, (chunks_, places, weights) in held.items():
                if len(numbers) > HELD:
                    numbers = _Numbers()
                batch = _Batch(chunks_, places, weights, numbers)
                for n, at, keys in grams(batch, lang, numbers):
                    if not len(at):
                        continue
                    pick, f = _summed(keys, batch.weights[at])
                    words = pa.array(numbers.words, pa.binary())
                    for k in range(0, len(pick), 1 << 17):
                        here = at[pick[k:k + (1 << 17)]]
                        parts = [words.take(pa.array(batch.ids[here + i])) for i in range(n)]
                        phrase = pc.binary_join_element_wise(*parts, b" ").cast(pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(here), np.int64))), phrase,
                             pa.array(np.full(len(here), n, np.int32)), pa.array(f[k:k + (1 << 17)])], names=["lang", "phrase", "words", "f"])
            held.clear()
            size = 0

        for batch in batches:
            for lang, chunk, places, weight in zip(*(batch.column(i).to_pylist() for i in range(4))):
                mine = held.get(lang)
                if mine is None:
                    mine = held[lang] = ([], [], [])
                for to, x in zip(mine, (chunk, places, weight)):
                    to.append(x)
                size += len(chunk)
                if size > HELD_BYTES:
                    yield from rows()
        yield from rows()

    counted = dictionary.select("lang", "chunk", "places", "frequency").mapInArrow(run, "lang string, phrase string, words int, f bigint")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _mixed(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A bit of the map for each pair of token hashes of a language."""
    h = (first ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29)) ^ second) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) % np.uint64(BITS)


def _token_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _pair_bits(pairs: DataFrame) -> np.ndarray:
    """Bitmap of ``pairs`` (lang, phrase) as bytes; built in pieces of 4 KB, of which there are BITS / 32,768 at most."""
    def bits(batches):
        for batch in batches:
            at = [np.zeros(0, np.uint64)]
            for lang, phrase in zip(*(batch.column(i).to_pylist() for i in range(2))):
                h = _token_hashes(phrase.encode("utf-8", "surrogatepass").split(b" "))
                at.append(_mixed(lang, h[:1], h[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at).astype(np.int64) + 1)], names=["at"])  # Spark counts bits from 1

    at = pairs.select("lang", "phrase").mapInArrow(bits, "at bigint")
    pieces = at.groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(BITS // 8)
    for r in pieces.collect():
        out[(r["piece"] - 1) * 4096:r["piece"] * 4096] = r["bits"]
    return np.frombuffer(bytes(out), np.uint8)


def phrase_counts(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to 4 words met at least ``least`` times, and (lang, n) of all words."""
    dictionary = store(parse(docs), "chunks")

    def short(b, lang, numbers):
        at = np.flatnonzero(b.starts)
        yield 1, at, b.ids[at]
        at = np.flatnonzero(b.starts[:-1] & b.pair)
        yield 2, at, b.ids[at] * len(numbers) + b.ids[at + 1]

    counted = store(_counted(dictionary, short).where((F.col("f") >= least)), "short-phrases")
    bits = dictionary.sparkSession.sparkContext.broadcast(_pair_bits(counted.where("words = 2")))

    def long_(b, lang, numbers):
        hashes = _token_hashes(numbers.words)
        at = np.flatnonzero(b.pair)
        bit = _mixed(lang, hashes[b.ids[at]], hashes[b.ids[at + 1]])
        frequent = np.zeros(len(b.ids) + 2, bool)
        frequent[at] = bits.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
        at = np.flatnonzero(b.starts & frequent[:-2] & frequent[1:-1])
        _, pairs = np.unique(b.ids[at] * len(numbers) + b.ids[at + 1], return_inverse=True)
        keys = pairs * len(numbers) + b.ids[at + 2] if len(at) else at
        yield 3, at, keys
        four = frequent[at + 2]
        _, triples = np.unique(keys[four], return_inverse=True)
        at = at[four]
        yield 4, at, triples * len(numbers) + b.ids[at + 3] if len(at) else at

    longer = store(_counted(dictionary, long_).where(F.col("f") >= least), "long-phrases")
    # A word is counted where it starts, so the places other than breaks are the words.
    breaks = F.expr("size(filter(slice(split(cast(chunk as string), ' '), 1, cast(places as int)), t -> t = '\n'))")
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("frequency") * (F.col("places") - breaks)).alias("n"))
    return counted.unionByName(longer), totals


def _exact(column: str) -> str:
    return f"cast({column} as decimal(38,0))"


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every phrase of two words or more, by its lowest-scoring cut."""
    whole = frequent.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice("w", 1, F.col("k")), " ")).withColumn("rest", F.array_join(F.expr("slice(w, k + 1, words - k)"), " "))
    of = frequent.select("lang", "phrase", "f")
    cuts = (cuts.drop("w").join(of.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(of.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    score = F.expr(f"cast(2000000 * {_exact('a')} div ({_exact('l')} + {_exact('r')}) as bigint)")
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def not_absorbed(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """``phrases`` (lang, phrase, words, a) without those inside a longer one that is met ``percent`` % as often or more."""
    longer = phrases.where("words > 2").select("lang", "words", F.split("phrase", " ").alias("w"), F.col("a").alias("f"))
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    most = longer.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    absorbed = F.expr(f"100 * {_exact('most')} >= {percent} * {_exact('a')}")
    return phrases.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | ~absorbed).drop("most")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of every language's best phrases."""
    frequent, totals = phrase_counts(docs, least)
    kept = not_absorbed(scored(frequent), percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocation(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece_id, lang, piece FROM (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
words AS (
    SELECT piece_id, lang, unnest(w) AS w1, unnest(range(len(w))) AS i
    FROM (SELECT piece_id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)),
followed AS (
    SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4
    FROM words WINDOW p AS (PARTITION BY piece_id ORDER BY i)),
grams AS (
    SELECT lang, 1 AS k, w1 AS phrase FROM followed
    UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM followed WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM followed WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM followed WHERE w4 IS NOT NULL),
counts AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
cuts AS (
    SELECT c.lang, c.phrase, c.a, p.cut, l.f AS l, r.f AS r,
           (CAST(2000000 AS HUGEINT) * c.a) // (CAST(l.f AS HUGEINT) + r.f) AS score
    FROM candidates c
    JOIN (SELECT unnest([1, 2, 3]) AS cut) p ON p.cut < c.k
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:p.cut], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[p.cut + 1:c.k], ' ')),
lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts),
inside AS (
    SELECT c.lang, array_to_string(c.w[s.i:s.i + s.m - 1], ' ') AS phrase, max(c.a) AS most
    FROM candidates c
    JOIN (SELECT * FROM (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m)) s ON s.m < c.k AND s.i + s.m - 1 <= c.k
    GROUP BY ALL),
ranked AS (
    SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest LEFT JOIN inside USING (lang, phrase)
    WHERE nth = 1 AND (most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT)))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
