import collections
import hashlib
import random

import numpy as np
import pyarrow as pa

from panelsplit.llm import substring
from panelsplit.llm.common import table
from panelsplit.llm.neardup import WordHashes
from panelsplit.llm.substring import duplicate_spans, factors, op3_substring_dedup, without_duplicates
from tests.llm import brute


def _rows(seed=1):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    passages = [rng.choices(vocabulary, k=n) for n in (12, 13, 14, 30, 80)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choices(vocabulary, k=rng.randint(0, 20))
            p = rng.choice(passages)
            a = rng.randint(0, 3)
            words += p[a:len(p) - rng.randint(0, 3)]
        rows.append((i * 3, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "a " * 60), (1003, "a " * 60), (1004, "Kept as one \t\n x"), (1005, " ".join(passages[4] * 60))]
    rng.shuffle(rows)
    return rows


def _compare(df, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in df.collect()}
    assert got == brute.without_repeats(rows)


def test_against_brute_force(documents, monkeypatch):
    rows = _rows()
    _compare(without_duplicates(documents(rows, extra=True)), rows)


def test_many_small_tasks(documents, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH_WORDS", 50)
    rows = _rows(2)
    _compare(without_duplicates(documents(rows).repartition(7)), rows)


def test_a_shared_passage_costs_its_block_an_entry_a_task():
    text = " ".join("w%d" % i for i in range(20))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([0] * 200), pa.array([text] * 200)], names=["doc_id", "row_key", "text"])

    def seeds(h):
        v = np.unique(substring.window_seeds(h, 13, 5))
        return v, np.zeros(len(v), np.uint32)

    met = collections.Counter()
    for rows in substring._entries(8, seeds, True)(iter([batch])):
        for r in rows.to_pylist():
            met.update((r["block"], v) for v in np.frombuffer(r["value"], "<u8").tolist())
    values = {v for _, v in met}
    assert sum(met.values()) >= 200 * len(values)
    for v in values:
        assert max(n for (_, w), n in met.items() if w == v) < 100  # of 200 documents


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op3_substring_dedup(spark, sf).collect()}
    assert got == brute.without_repeats(rows)


def test_rows_of_one_id_and_null_ids(documents):
    text = " ".join("w%d" % i for i in range(20))
    rows = [(4, text), (4, text), (4, "x " + text), (9, text), (None, text), (None, None)]
    got = sorted(((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in without_duplicates(documents(rows)).collect()))
    assert got == [(-1, 0, 0), (-1, 20, 0), (4, 20, 0), (4, 20, 0), (4, 21, 0), (9, 20, 20)]


def test_spans_and_empty(documents):
    assert without_duplicates(documents([])).count() == 0
    a = ["w%d" % i for i in range(40)]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in duplicate_spans(documents([(1, " ".join(a)), (2, " ".join(["x"] * 5 + a[3:20] + ["y"] + a[20:40]))])).collect()}
    assert got == {1: [], 2: [(5, 22), (23, 43)]}


def test_boundary_between_factors_is_checked():
    assert factors(np.array([1, 1, 0, 1, 0], bool), 3) == [(0, 4), (3, 6)]
    assert factors(np.zeros(0, bool), 3) == []


def test_runs_tell_orders_apart():
    words = WordHashes()
    h = np.array([words[w] for w in b"a b c d e f g a b c d e f h".split()], np.uint64)
    for width in (1, 2, 5, 6, 7):
        r = substring._runs(h, width)
        want = [tuple(h[i:i + width]) for i in range(len(h) - width + 1)]
        assert len(r) == len(want) and all((r[i] == r[j]) == (want[i] == want[j]) for i in range(len(r)) for j in range(len(r)))
        assert (substring._least(h, width) == [min(w) for w in want]).all()
