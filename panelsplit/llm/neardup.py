"""Near-duplicate groups by bottom-k MinHash sketches.

One hash function maps a document's word shingles to numbers; the ``sketch_size`` smallest are its sketch.

1. Documents with equal sets are one class, whose smallest doc_id stands for it.
2. Inverted lists of the retained values generate overlaps. Two sets of the wanted similarity share at
   least ``_least_overlap`` of their values, so a document needs to be listed only under its rarest
   values, all but that number less one; any order of the values that is the same for all documents
   will do, here rare before frequent.
3. Every list first compares its members with one of them, the hub (the member whose values are shared
   most): as many pairs as postings, and first each member's heaviest hub alone. The union sketch estimates the
   similarity, the full sets confirm it, and confirmed links make components. A member's set travels once a hub,
   and a hub's members are dealt into parts of bounded volume.
4. What is left are pairs of different components in one list. Short lists emit them; long ones are cut into blocks,
   and each pair of blocks counts its overlaps in one task. Sets that the sketches hold whole are decided there. For others, a member
   comes out once with the packed ids of those it may be similar to; its full set joins it, and the same pair of
   blocks is decided again. Both steps return a spanning forest of links, never all pairs. Of long lists, a pair
   is looked at in the one of its smallest common listed value alone.

No pair of different components with a common listed value is left out, so no list is too long and no
group too large. A pair is missed only if its sketches
overlap less than the bound, which is 5 standard deviations below the expected overlap of a pair at the
threshold (never for sets of at most 0.8 * sketch_size shingles, whose sketches are the sets).

Sets are sets of 64-bit hashes of the shingles. Words are runs of characters other than ASCII white
space, in lower case (A-Z only).

Edge cases: a null or empty text, or one without words, has no shingle, no link and is kept; a text of
fewer words than a shingle has one shingle, all its words; rows that share a doc_id are one document and
linked if any of their texts are; a null doc_id has no component and is kept; equal rows get equal
answers; extra columns are ignored; an empty table gives an empty result. ``without_near_duplicates`` keeps one of equal rows.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsplit.llm.common import slices, store, table
from panelsplit.llm.components import components

#: Lists up to this length emit their pairs; longer ones are compared in blocks.
SHORT_LIST = 16
#: Members of a block, and values of the full sets that a block or a part of a hub's members holds.
BLOCK = 1024
PART_VALUES = 1 << 21
#: Members of a block pair that are compared with all others at a time.
STRIP = 256
#: Values whose frequency is known to the order of the lists; the order, not the result, depends on it.
FREQUENT_VALUES = 1 << 16
#: Ids up to this number (16 MB) are broadcast to pick texts and sketches; beyond, these are joined by shuffle.
BROADCAST_IDS = 2_000_000


class WordHashes(dict):
    """64-bit hashes of words; forgets when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not raw:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, raw), np.uint64, len(raw))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _least_overlap(n: int, size: int, similarity: float) -> int:
    """Values that the sketch of a set of n shingles shares at least with that of a set of the wanted similarity."""
    kept = min(n, size)
    if n <= similarity * size:
        return max(1, math.ceil(similarity * n - 1e-9))
    low = similarity - 5 * math.sqrt(similarity * (1 - similarity) / size)
    return max(1, math.floor(low * kept))


def sketches(docs: DataFrame, width: int, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and sketch (sorted little-endian 64-bit values)."""
    def run(batches):
        words = WordHashes()
        for batch in slices(batches):
            n, keys, out = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_hashes(text, width, words)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out.append(s[:size].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, pa.binary())],
                                             names=["doc_id", "n_shingles", "set_key", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, sketch binary")


def _first_of_sets(batches, at_least: int = 1 << 21):
    """Batches as lists of (doc_id, n, values), each set once a task, joined until they hold ``at_least`` values."""
    seen, rows, held = set(), [], 0
    for batch in batches:
        for doc_id, n, key, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key not in seen:
                seen.add(key)
                rows.append((doc_id, n, np.frombuffer(raw, np.uint64)))
                held += len(raw) // 8
        if held >= at_least:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _frequent_values(sets: DataFrame) -> dict[str, np.ndarray]:
    """The most frequent values and how often they were met; counted where they meet in a task, so rare ones don't travel."""
    def count(batches):
        for rows in _first_of_sets(batches):
            v, c = np.unique(np.concatenate([r[2] for r in rows]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v[c > 1].astype(np.int64)), pa.array(c[c > 1])], names=["value", "n"])

    top = (sets.mapInArrow(count, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "value").limit(FREQUENT_VALUES).toPandas())
    v, n = top["value"].to_numpy(np.int64).astype(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(v)
    return {"value": v[order], "n": n[order]}


def _listed_values(sets: DataFrame, frequent: dict[str, np.ndarray], size: int, similarity: float) -> DataFrame:
    """doc_id, n_shingles and listed_values (packed, ascending): the values under which a document is listed."""
    known, times = frequent["value"], frequent["n"]

    def run(batches):
        for rows in _first_of_sets(batches, 1 << 19):
            out = []
            for _, n, v in rows:
                f = np.zeros(len(v), np.int64)
                if len(known):
                    k = np.minimum(np.searchsorted(known, v), len(known) - 1)
                    f = np.where(known[k] == v, times[k], 0)
                out.append(np.sort(v[np.lexsort((v, f))][:len(v) - _least_overlap(n, size, similarity) + 1]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(out, pa.binary())],
                                             names=["doc_id", "n_shingles", "listed_values"])

    return sets.mapInArrow(run, "doc_id bigint, n_shingles bigint, listed_values binary")


def _postings(listed: DataFrame) -> DataFrame:
    """value, doc_id, n_shingles: a row for each listed value."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = [np.frombuffer(v, np.int64) for v in part.column(2).to_pylist()]
                times = [len(v) for v in raw]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(raw)), pa.array(np.repeat(part.column(0).to_numpy(), times)), pa.array(np.repeat(part.column(1).to_numpy(), times))],
                    names=["value", "doc_id", "n_shingles"])

    return listed.mapInArrow(run, "value bigint, doc_id bigint, n_shingles bigint")


def _similar_sizes(a: str, b: str, similarity: float):
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6


def _union_estimate(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Share of the ``size`` smallest values of the union that are in both sketches."""
    both = np.concatenate([a, b])
    both.sort()
    twice = np.flatnonzero(both[1:] == both[:-1])
    union = len(both) - len(twice)
    if union <= size:
        return len(twice) / max(1, union)
    # The position of a value among the distinct ones is its index less the doubles before it.
    return np.searchsorted(twice - np.arange(len(twice)), size) / size


def _estimated(pairs: DataFrame, sets: DataFrame, similarity: float, size: int = 64) -> DataFrame:
    """Pairs (a, b) whose union sketch of ``size`` values does not rule them out (5 standard deviations)."""
    short = sets.select("doc_id", F.substring("sketch", 1, 8 * size).alias("sketch"))
    low = similarity - 5 * math.sqrt(similarity * (1 - similarity) / size)
    both = (pairs.join(short.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), "a")
            .join(short.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")), "b").select("a", "b", "sa", "sb"))

    def run(batches):
        for batch in batches:
            keep = [_union_estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), size) >= low
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the documents in ``ids`` (stored); while these are few, no other row travels."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _full_sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """doc_id and hashes (the whole set) of the documents in ``ids``, one row a text, stored."""
    texts = _only(docs.select("doc_id", "text"), ids)

    def full(batches):
        words = WordHashes()
        for batch in slices(batches):
            out = [shingle_hashes(t, width, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "hashes"])

    return store(texts.mapInArrow(full, "doc_id bigint, hashes binary"), "full-sets")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a member and its hub whose full sets have the wanted similarity.

    A member's set travels once a hub, and the hub's set once for each part of its members; the parts hold
    ``PART_VALUES`` values, so that no hub's members meet in one task.
    """
    size = (F.length("hashes") / 8).cast("long")
    members = pairs.join(sets.select(F.col("doc_id").alias("a"), "hashes"), "a")
    volume = pairs.join(sets.select(F.col("doc_id").alias("a"), size.alias("values")), "a").groupBy("b").agg(F.sum("values").alias("values"))
    parts = volume.select("b", F.ceil(F.col("values") / PART_VALUES).cast("int").alias("parts"))
    members = (members.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.greatest("parts", F.lit(1))).cast("int").alias("part"), "a", "hashes"))
    hubs = (parts.join(sets.select(F.col("doc_id").alias("b"), "hashes"), "b")
            .select("b", F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "hashes"))

    def run(group: pa.Table) -> pa.Table:
        ids, hubs_, raw = group.column("a").to_pylist(), group.column("b")[0].as_py(), group.column("hashes").to_pylist()
        mine = [np.frombuffer(h, np.uint64) for a, h in zip(ids, raw) if a is None]  # a doc_id can have several texts
        kept = sorted({a for a, h in zip(ids, raw) if a is not None and any(_similar(np.frombuffer(h, np.uint64), m, percent) for m in mine)})
        return pa.table({"a": pa.array(kept, pa.int64()), "b": pa.array([hubs_] * len(kept), pa.int64())})

    return members.unionByName(hubs).groupBy("b", "part").applyInArrow(run, "a bigint, b bigint")


def _overlaps(sketches_: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values of all pairs of a block pair's members."""
    m = len(sketches_)
    member = np.repeat(np.arange(m), [len(s) for s in sketches_])
    value, which = np.unique(np.concatenate(sketches_), return_inverse=True)
    order = np.argsort(which, kind="stable")
    member, count = member[order], np.bincount(which, minlength=len(value))
    ends = np.cumsum(count)
    out = np.zeros((m, m), np.float32)
    dense = np.flatnonzero(count >= 64)
    for at in range(0, len(dense), 1024):
        part = np.zeros((m, len(dense[at:at + 1024])), np.float32)
        for j, k in enumerate(dense[at:at + 1024]):
            part[member[ends[k] - count[k]:ends[k]], j] = 1
        for to in range(0, m, STRIP):
            out[to:to + STRIP] += part[to:to + STRIP] @ part.T
    for k in np.flatnonzero((count > 1) & (count < 64)):
        of = member[ends[k] - count[k]:ends[k]]
        out[of[:, None], of] += 1
    return out


def _forest():
    """``join(a, b)`` says whether a and b were apart, and joins them."""
    group = {}

    def find(c):
        while group.setdefault(c, c) != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    def join(a, b, only_ask=False):
        a, b = find(a), find(b)
        if a != b and not only_ask:
            group[max(a, b)] = min(a, b)
        return a != b

    return join


_FOUND = "value bigint, i long, j long, doc_id bigint, component bigint, partners binary, link bigint"


def _block_pairs(size: int, similarity: float):
    """applyInPandas body, one pair of blocks of a list: links of different components, proven by whole sketches (a forest), and
    for every member the packed ids of those members that only its full set can tell from it.

    A pair is looked at in the list of its smallest common listed value alone. Members meet the others ``STRIP`` at a time, so
    that a task holds one number and one mark a pair."""
    low = similarity - 5 * math.sqrt(similarity * (1 - similarity) / size)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        value, bi, bj = (int(block[c].iloc[0]) for c in ("value", "i", "j"))
        ids, comps, n, mine = (block[c].to_numpy() for c in ("doc_id", "component", "n_shingles", "mine"))
        values = [np.frombuffer(s, np.uint64) for s in block["sketch"]]
        listed = [np.frombuffer(s, np.int64) for s in block["listed_values"]]
        kept = np.minimum(n, size)
        whole = n <= size
        may = np.empty((len(ids), len(ids)), bool)
        strips = [slice(at, at + STRIP) for at in range(0, len(ids), STRIP)]
        overlap = _overlaps(values)
        for s in strips:
            ratio = overlap[s] / np.maximum(1, kept[s, None] + kept - overlap[s])
            # Of two partial sketches, the overlap itself bounds the union estimate from above.
            may[s] = np.where(whole[s, None] & whole, ratio >= similarity - 1e-6, overlap[s] >= low * np.minimum(kept[s, None], kept))
            may[s] &= comps[s, None] != comps
            may[s] &= np.minimum(n[s, None], n) >= similarity * np.maximum(n[s, None], n) - 1e-6
            if bi != bj:
                may[s] &= mine[s, None] != mine
        del overlap
        smaller = _overlaps([v[v < value] for v in listed])
        for s in strips:
            may[s] &= smaller[s] == 0  # no smaller list has both
        del smaller

        def pairs(proven):
            for s in strips:
                x, y = np.nonzero(np.triu(may[s] & ((whole[s, None] & whole) == proven), 1 + s.start))
                yield from zip(x + s.start, y)

        apart = _forest()
        rows, partners = [], {}
        for x, y in pairs(True):
            if apart(comps[x], comps[y]):
                rows.append((int(ids[x]), int(comps[x]), None, int(ids[y])))
        for x, y in pairs(False):
            if not apart(comps[x], comps[y], True):
                continue
            if _union_estimate(values[x], values[y], size) >= low:
                partners.setdefault(x, array("q")).append(int(ids[y]))
                partners.setdefault(y, array("q"))
        rows += [(int(ids[x]), int(comps[x]), p.tobytes(), None) for x, p in partners.items()]
        out = pd.DataFrame(rows, columns=["doc_id", "component", "partners", "link"])
        return out.assign(value=value, i=bi, j=bj, link=out["link"].astype("Int64"))[["value", "i", "j", "doc_id", "component", "partners", "link"]]

    return run


def _verified(percent: int):
    """applyInPandas body: of the pairs that a pair of blocks could not tell, the links, a forest."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        sets, of = {}, {}
        for doc_id, component, raw in zip(block["doc_id"], block["component"], block["hashes"]):
            sets.setdefault(doc_id, []).append(np.frombuffer(raw, np.uint64))
            of[doc_id] = component
        apart, links = _forest(), []
        for doc_id, raw in zip(block["doc_id"], block["partners"]):
            for other in np.frombuffer(raw, np.int64).tolist():
                if apart(of[doc_id], of[other], True) and any(_similar(x, y, percent) for x in sets[doc_id] for y in sets[other]):
                    apart(of[doc_id], of[other])
                    links.append((doc_id, other))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _rest(lists: DataFrame, listed: DataFrame, labels: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int, size: int) -> DataFrame:
    """Links between different components within a list."""
    member = lists.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    member = store(member, "list-members")
    open_ = (member.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"), F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo <> hi").select("value", "members", "shingles"))
    member = store(member.join(open_, "value"), "open-lists")
    short = member.where(F.col("members") <= SHORT_LIST)
    left = short.select("value", F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("component").alias("ca"))
    right = short.select("value", F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("component").alias("cb"))
    pairs = left.join(right, "value").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _similar_sizes("na", "nb", percent / 100)).select("a", "b").distinct()
    pairs = store(_estimated(pairs, sets, percent / 100), "short-list-pairs")
    # Equal lists would do equal work: of those with the same members, the one with the smallest value is compared.
    long_ = member.where(F.col("members") > SHORT_LIST)
    alike = long_.groupBy("value", "members").agg(F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("who")).groupBy("members", "who").agg(F.min("value").alias("value"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / PART_VALUES))
    own = long_.join(alike.select("value"), "value").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    compared = store(own.select("doc_id").distinct(), "compared-ids")
    dealt = (own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
             .join(_only(sets.select("doc_id", "sketch"), compared), "doc_id").join(_only(listed.select("doc_id", "listed_values"), compared), "doc_id")
             .select("value", "i", "j", "mine", "doc_id", "component", "n_shingles", "sketch", "listed_values"))
    found = store(dealt.groupBy("value", "i", "j").applyInPandas(_block_pairs(size, percent / 100), _FOUND), "block-pairs")
    links = found.where("link is not null").select(F.col("doc_id").alias("a"), F.col("link").alias("b"))
    asked = found.where("link is null").drop("link")
    ids = asked.select("doc_id").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))).distinct()
    full = _full_sets(store(ids, "asked-ids"), docs, width)
    proven = asked.join(full, "doc_id").groupBy("value", "i", "j").applyInPandas(_verified(percent), "a bigint, b bigint")
    return links.unionByName(proven).unionByName(_confirmed(pairs, full, percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, sketch_size: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group) and kept, one row per row of ``docs``."""
    similarity = percent / 100
    rows = store(sketches(docs, width, sketch_size), "sketches")
    named = rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("class_id"))
    of_class = store(named.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "class_id").distinct(), "classes")
    # One doc_id with several texts links their classes.
    several = of_class.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = of_class.join(several, "doc_id").select(F.col("class_id").alias("a"), "b").where("a <> b")

    sets = named.select("doc_id", "n_shingles", "set_key", "sketch")
    values = store(_listed_values(sets, _frequent_values(sets), sketch_size, similarity), "listed-values")
    postings = _postings(values)
    shared = postings.groupBy("value").agg(F.count(F.lit(1)).alias("listed")).where("listed > 1")
    lists = postings.join(shared, "value").join(of_class, "doc_id").select("value", F.col("class_id").alias("doc_id"), "n_shingles", "listed")
    lists = store(lists.distinct(), "lists")

    weight = lists.groupBy("doc_id").agg(F.avg("listed").alias("weight"))
    weighted = lists.join(weight, "doc_id")
    hubs = weighted.groupBy("value").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus_id"), "n_shingles")).alias("hub"))
    spokes = (weighted.join(hubs, "value").select(F.col("doc_id").alias("a"), (-F.col("hub.minus_id")).alias("b"), F.col("n_shingles").alias("na"), F.col("hub.n_shingles").alias("nb"), F.col("hub.weight").alias("w"))
              .where((F.col("a") != F.col("b")) & _similar_sizes("na", "nb", similarity)).select("a", "b", "w").distinct())
    best = spokes.groupBy("a").agg(F.max_by("b", F.struct("w", -F.col("b"))).alias("best"))
    near = store(_estimated(spokes.select("a", "b"), sets, similarity), "spokes")
    full = _full_sets(store(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "spoke-ids"), docs, width)
    # Every member with its heaviest hub first; then only pairs that are still apart.
    first = near.join(best, "a").where(F.col("b") == F.col("best")).select("a", "b")
    links = store(_confirmed(first, full, percent).unionByName(links), "hub-links")
    labels = store(components(links), "labels")

    def of(end):
        return labels.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))

    apart = (near.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))
    links = store(_confirmed(apart, full, percent).unionByName(links), "hub-links")
    labels = components(links).withColumnRenamed("id", "doc_id")

    rest = _rest(lists.drop("listed"), values, labels, sets, docs, width, percent, sketch_size)
    labels = components(links.unionByName(rest)).withColumnRenamed("id", "class_id")
    smallest = of_class.join(labels, "class_id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "class_id")).alias("component_id"))
    return (rows.select("doc_id", "n_shingles").join(smallest, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group: of rows alike in doc_id and text one, and a row with a null
    doc_id takes part like others (by a negative number made of its text)."""
    made = -F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 2) - 1
    own = F.coalesce("doc_id", made)
    gone = near_duplicates(docs.select(own.alias("doc_id"), "text"), width, percent).where(~F.col("kept")).select("doc_id").distinct()
    rows = docs.select(own.alias("own_id"), F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(gone.withColumnRenamed("doc_id", "own_id"), "own_id", "left_anti")
    # Few rows recur; only those are brought together.
    again = store(rows.groupBy("own_id", "text_key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("own_id", "text_key"), "repeated-rows")
    once = rows.join(again, ["own_id", "text_key"], "left_anti").select("row")
    repeated = rows.join(again, ["own_id", "text_key"], "left_semi").groupBy("own_id", "text_key").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(repeated).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
