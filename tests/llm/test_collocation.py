import collections
import random
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelsplit.llm import collocation
from panelsplit.llm.collocation import OP11_SQL, WINDOW, _Hashes, chunks, collocations, phrase_counts, scored, tokens


def brute_counts(rows):
    """lang -> Counter of phrases of up to 4 words."""
    out = {}
    for text, lang in rows:
        f = out.setdefault(lang or "und", collections.Counter())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            for k in range(1, 5):
                f.update(b" ".join(w[i:i + k]).decode() for i in range(len(w) - k + 1))
    return out


def brute(rows, least=30, top=2000):
    found = []
    for lang, f in brute_counts(rows).items():
        n = sum(v for p, v in f.items() if " " not in p)
        c = {p: v for p, v in f.items() if v >= least and " " in p}
        best = []
        for p, a in c.items():
            w = p.split(" ")
            cuts = [(2000000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            held = any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * b >= 80 * a for q, b in c.items())
            if not held:
                best.append((-score, -a, p.encode(), p, a, f[" ".join(w[:k])], f[" ".join(w[k:])], n, score))
        found += [(lang, i + 1, *x[3:]) for i, x in enumerate(sorted(best)[:top])]
    return sorted(found)


def _got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def _rows(n=250):
    rng = random.Random(8)
    vocabulary = ["a", "B", "c", "É", "ß", "d e", "new", "York", "City", "the", "of"]
    passage = "In the  new York City\tof the a; b " * 6
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" "] * 8 + [". ", ",", "\n", "\t", " \r\n"]) for _ in range(rng.randint(0, 80)))
        rows.append((text + (passage if i % 5 == 0 else ""), rng.choice(("en", "en", "fr", None, "und"))))
    return rows + [(None, "en"), ("", "fr"), (" \t . ", None), ("only . . ! one", "xx"), ("Y " * 500, "de")]


def _documents(spark, rows):
    from tests.llm.conftest import DOCUMENTS
    return spark.createDataFrame([(i // 2, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(rows)], DOCUMENTS).withColumn("rank", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("phrase", F.lit("clash"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"\n"]), max_size=60), st.integers(1, 5))
def test_places_cover_the_text_once(of, period):
    before, collocation.PERIOD = collocation.PERIOD, period
    try:
        got = chunks(of, _Hashes())
    finally:
        collocation.PERIOD = before
    assert sum(p for _, p in got) == len(of)
    want = collections.Counter(tuple(of[i:i + k]) for k in range(1, WINDOW + 2) for i in range(len(of) - k + 1))
    have = collections.Counter()
    for chunk, places in got:
        t = chunk.split(b" ")
        have.update(tuple(t[i:i + k]) for k in range(1, WINDOW + 2) for i in range(places) if i + k <= len(t))
    assert want == have


def test_tokens():
    assert tokens("A b\tC.d;;\n É!") == [b"a", b"b", b"c", b"\n", b"d", b"\n", "É".encode()]
    assert tokens(None) == tokens(" . ") == []


def test_matches_brute_force_and_sql(spark, monkeypatch):
    rows = _rows()
    want = brute(rows)
    assert len(want) > 30 and {r[0] for r in want} >= {"en", "fr", "und", "de"}
    docs = _documents(spark, rows)
    assert _got(collocations(docs)) == want
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    rel = con.sql(OP11_SQL)
    assert sorted(tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()) == want


def test_short_report_and_low_threshold(spark):
    rows = _rows(60)
    assert _got(collocations(_documents(spark, rows), least=2, top=5)) == brute(rows, least=2, top=5)


def test_counts_of_repeated_text_are_weighted(spark):
    rows = [("one two three four five six seven " * 30, "en")] * 40
    frequent, totals = phrase_counts(_documents(spark, rows))
    f = {r["phrase"]: r["f"] for r in frequent.collect()}
    want = {p: v for p, v in brute_counts(rows)["en"].items() if v >= 30}
    assert f == want and totals.collect()[0]["n"] == 40 * 210


def test_arithmetic_beyond_64_bits(spark):
    big = 9 * 10 ** 18
    frequent = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1), ("en", "c", 1, 3), ("en", "a c", 2, 3)], "lang string, phrase string, words int, f bigint")
    got = {r["phrase"]: r["score"] for r in scored(frequent).collect()}
    assert got == {"a b": 2000000 * (big - 1) // (2 * big), "a c": 0}


def test_empty(spark):
    assert collocations(_documents(spark, [])).count() == 0
    assert collocations(_documents(spark, [(None, None)])).count() == 0
