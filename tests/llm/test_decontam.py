import random

import numpy as np

from panelsplit.llm import decontam
from panelsplit.llm.common import table
from panelsplit.llm.decontam import Items, cgk, contaminated_windows, edit_bound, least_edits, normal_words, op6_benchmark_decontamination, without_contaminated


def _edits(item, words):
    """Smallest edit distance of item from any window of words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(words):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def _expected(docs, items, max_edits=0.2):
    out = set()
    for i, t in docs:
        w = normal_words(t)
        for k, item in items:
            n = normal_words(item)
            if len(n) >= 5:
                d = _edits(n, w)
                if d <= edit_bound(len(n), max_edits):
                    out.add((i, k, d))
    return out


def _tables(rng):
    vocabulary = ["v%d" % i for i in range(40)] + ["the", "of", "a"] * 15
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([5, 6, 9, 14, 25, 45])))) for k in range(25)]
    docs = []
    for i in range(140):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, max(1, len(part) // 4))):
                at = rng.randrange(len(part))
                kind = rng.random()
                part[at:at + (kind > .3)] = [] if kind > .7 else [rng.choice(vocabulary)]
            cut = rng.randint(0, len(words))
            words[cut:cut] = part
        docs.append((i, " ".join(w.upper() + "!!" if i % 5 == 0 else w for w in words)))
    return docs, items


def test_against_brute_force(spark, documents):
    docs, items = _tables(random.Random(3))
    docs += [(900, None), (901, ""), (902, items[4][1]), (903, "x " * 5000 + items[5][1])]
    benchmark = spark.createDataFrame([(k, t, "clash") for k, t in items + [(90, None), (91, ""), (92, "two words")]], "item_id long, text string, distance string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in contaminated_windows(documents(docs, extra=True), benchmark).collect()}
    want = _expected(docs, items)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 100
    spans = contaminated_windows(documents(docs), benchmark).collect()
    by_id, by_item = dict(docs), dict(items)
    for r in spans:
        assert _edits(normal_words(by_item[r["item_id"]]), normal_words(by_id[r["doc_id"]])[r["start"]:r["end"]]) == r["distance"]


def test_blocks_of_items_give_the_same(spark, documents, monkeypatch):
    docs, items = _tables(random.Random(4))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, contaminated_windows(documents(docs), benchmark).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 200)
    assert sorted(map(tuple, contaminated_windows(documents(docs), benchmark).collect())) == one


def test_stage_drops_only_matches(spark, documents):
    item = "seven words make up this benchmark item"
    rows = [(1, "before " + item + " after"), (2, "clean text of some words"), (2, item), (None, item), (None, None), (4, None)]
    docs = documents(rows, extra=True).withColumnRenamed("score", "hit_id").withColumnRenamed("kind", "hit_key").withColumnRenamed("rank", "text_key")
    kept = without_contaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (2, "clean text of some words"), (4, "")]
    assert without_contaminated(documents(rows), spark.createDataFrame([], "item_id long, text string")).count() == len(rows)
    assert contaminated_windows(documents([]), spark.createDataFrame([(0, item)], "item_id long, text string")).count() == 0


def test_embedding_agrees_at_the_bound():
    """A window with as many edits as allowed still agrees on the share of positions that the tables count on."""
    rng = random.Random(6)
    shares = []
    for _ in range(200):
        n = rng.randint(15, 60)
        a = [rng.randint(1, 2 ** 60) for _ in range(n)]
        b = list(a)
        for _ in range(edit_bound(n, 0.2)):
            at, kind = rng.randrange(len(b)), rng.random()
            b[at:at + (kind > .3)] = [] if kind > .7 else [rng.randint(1, 2 ** 60)]
        rows = np.zeros((2, max(len(a), len(b))), np.uint64)
        rows[0, :len(a)], rows[1, :len(b)] = a, b
        e = cgk(rows, int(1.5 * n), rng.randint(0, 7))
        shares.append((e[0] == e[1]).mean())
    assert np.mean(shares) > decontam.AGREEMENT


def _at_the_bound(rng, n, substitutions):
    """An item, and words that hold it with as many edits as allowed."""
    a = ["w%d" % rng.randrange(10 ** 9) for _ in range(n)]
    b = list(a)
    for at in sorted(rng.sample(range(n), edit_bound(n, 0.2)), reverse=True):
        kind = 0 if substitutions else rng.randrange(3)  # 1 drops a word, 2 puts one in
        b[at:at + (kind < 2)] = [] if kind == 1 else ["new%d" % rng.randrange(10 ** 9)]
    return " ".join(a), ["x%d" % i for i in range(7)] + b + ["y%d" % i for i in range(9)]


def _found(pairs, max_edits=0.2):
    items = Items([(k, item) for k, (item, _) in enumerate(pairs)], max_edits, 5, 0.999)
    words = decontam.WordHashes()
    got = items.find([np.array([words[w.encode()] for w in doc], np.uint64) for _, doc in pairs])
    return [any(k == x[0] for x in found) for k, found in enumerate(got)]


def test_recall_at_the_bound_for_long_items():
    rng = random.Random(11)
    for substitutions in (True, False):
        for n in (30, 60, 100, 200, 400, 1000):
            found = _found([_at_the_bound(rng, n, substitutions) for _ in range(60)])
            assert sum(found) == len(found), (n, substitutions, sum(found))


def test_more_edits_than_measured_are_verified():
    rng = random.Random(12)
    pairs = []
    for _ in range(40):
        a = ["w%d" % rng.randrange(10 ** 9) for _ in range(200)]
        b = list(a)
        for at in range(edit_bound(200, 0.3)):
            b[3 * at + 2] = "new%d" % at
        pairs.append((" ".join(a), b))
    assert all(_found(pairs, 0.3))


def test_edit_distance():
    rng = random.Random(8)
    for _ in range(300):
        item, words = rng.choices("abc", k=rng.randint(1, 8)), rng.choices("abc", k=rng.randint(0, 15))
        d, end = least_edits(item, words)
        assert d == _edits(item, words) and _edits(item, words[:end]) == d


def test_query_catches_whole_items(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], " ".join(w.decode() for w in normal_words(r["text"]))) for r in table(spark, sf, "documents").collect()]
    items = [(r["item_id"], " ".join(w.decode() for w in normal_words(r["text"]))) for r in table(spark, sf, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op6_benchmark_decontamination(spark, sf).where("distance = 0").collect()}
    assert got == {(i, k) for i, t in docs for k, item in items if f" {item} " in f" {t} "}
