import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelsplit.llm import periodic
from panelsplit.llm.periodic import COVER, MARKS, Extensions, find_runs, periodic_runs, run_digest, with_planted_runs
from tests.llm import brute


def brute_runs(w, exponent=4, least=6):
    """All runs by the definition: maximal stretches of every period, kept with their smallest period."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, m, q) for (s, m), q in out.items())


def test_cover_has_every_difference():
    assert {(a - b) % COVER for a in MARKS for b in MARKS} == set(range(COVER))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=8))
def test_runs_match_brute_force(parts):
    w = [x for part, times in parts for x in part * times]
    assert [tuple(r) for r in find_runs(np.array(w, np.int32)).tolist()] == brute_runs(w)


def test_extensions_match_brute_force():
    rng = random.Random(3)
    for n in (40, 200, 700):
        block = [rng.randrange(3) for _ in range(50)]
        w = np.array([(block * (n // 50 + 1))[i] if rng.random() > 0.004 else 9 for i in range(n)], np.int32)
        extend = Extensions(w)
        pairs = [sorted(rng.sample(range(n), 2)) for _ in range(400)]
        got = extend(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        for (a, b), m in zip(pairs, got.tolist()):
            assert w[a:a + m].tolist() == w[b:b + m].tolist()
            assert b + m == n or w[a + m] != w[b + m]


def test_long_sequences_in_pieces(monkeypatch):
    rng = random.Random(4)
    w = []
    while len(w) < 4000:
        part = [rng.randrange(40) for _ in range(rng.randint(1, 60))]
        w += part * rng.choice((1, 1, 2, 5, 9))
    want = brute_runs(w)
    assert len(want) > 5 and [tuple(r) for r in find_runs(np.array(w, np.int32)).tolist()] == want
    monkeypatch.setattr(periodic, "PAIRS", 100)
    assert [tuple(r) for r in find_runs(np.array(w, np.int32)).tolist()] == want


def expected(doc_id, text):
    w = brute.words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    covered = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in covered)).hexdigest())


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_matches_brute_force(documents):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["a", "b", "é", "çç", "d e"], k=rng.randint(0, 90))) + rng.choice(("", "\n", " x" * 7, "\t1 2 3" * 6))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a a a a a"), (1004, "a a a a a a"), (1005, "word " * 30000), (None, "x y " * 8), (1004, "a a a a a a")]
    got = run_digest(periodic_runs(with_planted_runs(documents(rows, extra=True)), "doc_id")).collect()
    assert len(got) == len(rows)
    small = [r for r in rows if r[0] != 1005]
    assert sorted(map(repr, ((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got if r["doc_id"] != 1005))) == sorted(map(repr, ((i, *expected(i, t)) for i, t in small)))
    long_ = next(r for r in got if r["doc_id"] == 1005)
    assert (long_["n_runs"], long_["start"], long_["length"], long_["period"]) == (1, 0, 30000, 1)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5


def test_kept_columns_and_thresholds(documents):
    docs = documents([(1, "a b a b c"), (2, "a a a")], extra=True)
    got = {r["doc_id"]: r for r in periodic_runs(docs, "doc_id", "kind", exponent=2, least=2).collect()}
    assert got[1]["kind"] == "clash" and got[1]["collapsed"] == "a b c"
    assert [(r["start"], r["length"], r["period"]) for r in got[1]["runs"]] == [(0, 4, 2)]
    assert got[2]["collapsed"] == "a" and got[2]["n_words"] == 3


def test_empty(documents):
    assert run_digest(periodic_runs(documents([]), "doc_id")).count() == 0
