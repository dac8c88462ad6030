import random
import tracemalloc

import numpy as np
import pandas as pd

from panelsplit.llm import neardup
from panelsplit.llm.components import components
from tests.llm import brute


def _words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + str(rng.randint(0, 99)) for _ in range(n)]


def _edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = "edit%d" % rng.randint(0, 10 ** 6)
    return out


def _rows(seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    passage = _words(rng, 40)
    for n in (5, 12, 60, 200, 700):  # families of near copies around originals of several lengths
        base = _words(rng, n)
        for k in range(25):
            rows.append((i, " ".join(_edited(rng, base, rng.choice([0, 1, 1, 2, n // 40, n // 15])))))
            i += 1
    for _ in range(60):  # a passage that many share
        rows.append((i, " ".join(_words(rng, 50) + passage + _words(rng, 60))))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "one"), (i + 4, "One"), (i + 5, "two words"), (i + 6, "x " * 40), (i + 7, "x " * 900)]
    rng.shuffle(rows)
    return rows


def _compare(docs, rows, **kw):
    want = brute.components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, width=4, **kw).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    return want


def test_against_brute_force(documents):
    rows = _rows()
    want = _compare(documents(rows, extra=True), rows)
    assert len({c for _, c in want.values()}) < len(rows)


def test_long_lists_in_small_blocks(documents, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 2)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "PART_VALUES", 3000)
    rows = _rows(2)
    _compare(documents(rows), rows)
    _compare(documents(rows), rows, sketch_size=128)


def test_only_sketches_of_compared_documents_travel(documents, monkeypatch):
    rows = _rows(5)
    rows += [(10_000 + i, " ".join(_words(random.Random(i), 30))) for i in range(100)]  # alike to nothing
    picked, only = [], neardup._only
    monkeypatch.setattr(neardup, "_only", lambda of, ids: picked.append((of.columns, {r[0] for r in ids.collect()})) or only(of, ids))
    _compare(documents(rows), rows)
    ids = [i for columns, i in picked if "sketch" in columns or "listed_values" in columns]
    assert len(ids) == 2 and ids[0] == ids[1] and 0 < len(ids[0]) < 200 and max(ids[0]) < 10_000


def _block(m, seed=1):
    """A pair of blocks of m members, each with most of 250 common values and a few own ones; a third of the sketches are partial."""
    rng = np.random.default_rng(seed)
    pool = np.sort(rng.integers(1, 2 ** 62, 250).astype(np.uint64))
    rows = []
    for i in range(m):
        values = np.unique(np.concatenate([rng.choice(pool, 235 if i % 3 else 245, replace=False), rng.integers(1, 2 ** 62, 5 if i % 3 else 25).astype(np.uint64)]))
        rows.append((0, 0, 1, i % 2, i, i, len(values), values[:256].tobytes(), values[:40].tobytes()))
    return pd.DataFrame(rows, columns=["value", "i", "j", "mine", "doc_id", "component", "n_shingles", "sketch", "listed_values"])


def test_memory_of_a_pair_of_blocks():
    m, block = 1024, _block(1024)
    tracemalloc.start()
    try:
        found = neardup._block_pairs(256, 0.8)(block)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) and peak < 24 * m * m  # 4 bytes a pair for its overlap, 1 for the mark, and what grows with the members


def test_strips_give_the_same_links(monkeypatch):
    want = neardup._block_pairs(256, 0.8)(_block(150))
    assert want["link"].notna().any() and want["partners"].notna().any()
    for strip in (1, 7, 150):
        monkeypatch.setattr(neardup, "STRIP", strip)
        pd.testing.assert_frame_equal(neardup._block_pairs(256, 0.8)(_block(150)), want)


def test_without_broadcast(documents, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    rows = _rows(3)[:80]
    _compare(documents(rows), rows)


def test_repeated_rows_and_null_ids(documents):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (7, "other words stand here now"), (9, "other words stand here now"), (None, "a b c d e f"), (None, None)]
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(documents(rows), width=4).collect()), key=str)
    assert got == sorted([(5, 3, 5, True), (5, 3, 5, True), (7, 3, 5, False), (7, 2, 5, False), (9, 2, 5, False), (-1, 3, None, True), (-1, 0, None, True)], key=str)


def test_large_groups_of_long_texts(documents, spark, monkeypatch):
    """Groups whose members are near their neighbours but not near all: rows between the steps stay with the members."""
    rng = random.Random(11)
    rows = []
    for g in range(2):
        base = _words(rng, 700)
        for k in range(150):
            rows.append((len(rows), " ".join(_edited(rng, base, rng.choice([0, 10, 20, 22, 24, 30])))))
    made = {}
    plain = neardup.store

    def counted(df, name):
        out = plain(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(neardup, "store", counted)
    want = _compare(documents(rows), rows)
    assert 2 < len({c for _, c in want.values()}) < len(rows)
    assert made["block-pairs"] <= 90 * len(rows)


def test_stage_keeps_one_of_equal_rows(documents):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "another text of the same id"), (None, "g h i j k l"), (None, "g h i j k l"), (8, "g h i j k l"), (None, None), (None, None), (9, None)]
    docs = documents(rows, extra=True).withColumnRenamed("score", "gone_id").withColumnRenamed("kind", "own_id")
    got = neardup.without_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    # The null id's number is below 8, so that row stands for its group.
    assert kept == sorted([(5, "a b c d e f"), (5, "another text of the same id"), (None, "g h i j k l"), (None, None), (9, None)], key=str)


def test_empty(documents):
    assert neardup.near_duplicates(documents([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(50)}, 200: 200, 201: 200}


def test_union_estimate_is_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pool = rng.integers(0, 2 ** 40, 120).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, 90)) for _ in range(2))
        for k in (8, 32, 500):
            sa, sb = a[:k], b[:k]
            union = sorted(set(sa.tolist()) | set(sb.tolist()))[:k]
            assert neardup._union_estimate(sa, sb, k) == sum(v in sa and v in sb for v in union) / len(union)
