import hashlib
import random

from panelsplit.llm.secrets import mask_secrets, scan_secrets, span_digest
from tests.llm import brute


def _digest(docs):
    return span_digest(docs, scan_secrets(docs))


def test_base_spans_match_the_patterns(documents):
    rng = random.Random(5)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcd", "deadbeef" * 4, "AKIA", "Q1" * 7, "é", "ſecret", "x/y+z=1", "\n", "0" * 31]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 30)))) for i in range(150)] + [(200, None), (201, "")]
    got = {r["doc_id"]: r for r in _digest(documents(rows, extra=True)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        spans = brute.secret_bases(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == kind for k, *_ in spans) for kind in ("assign", "access", "hex"))
        assert set(filter(None, listed.split(","))) <= set(got[i]["spans"].split(","))


def test_weak_parts_need_a_complement_in_reach(documents):
    far = " word" * 200
    rows = [(1, "user: annabel likes tea"), (2, "user: annabel and password = hunter2hunter2"), (3, "https://db.example.org/x" + far + "token = abcdefgh1234"),
            (4, "https://db.example.org/x token = abcdefgh1234"), (5, "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5MGFiY2RlZmdo"), (6, "login=root at redis://h:1 Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5MGFiY2RlZmdo")]
    kinds = {}
    for r in scan_secrets(documents(rows)).collect():
        kinds.setdefault(r["doc_id"], set()).add(r["kind"])
    assert kinds == {2: {"assign", "weak_id"}, 3: {"assign"}, 4: {"assign", "endpoint"}, 6: {"weak_id", "weak_secret", "endpoint"}}


def test_keys_of_other_lengths(documents):
    rows = []
    for n in (20, 24, 43, 64, 86, 128, 130, 999):
        key = ("Zm9vYmFyQmF6UXV4MTIz" * 50)[:n] + "=" * (-n % 4 % 3)
        rows += [(n, f"x AccountName=devstore;AccountKey={key};y"), (1000 + n, f"x AccountKey={key};y"), (2000 + n, f"user_name: annabel, key {key}")]
    got = {i: t for i, t in ((r["doc_id"], r["text"]) for r in mask_secrets(documents(rows)).collect())}
    for i, text in rows:
        if 1000 < i < 2000 or i % 1000 == 20:  # no identifier, or too short
            assert got[i] == text
        else:
            assert got[i] == ("x AccountName=<secret>;AccountKey=<secret>;y" if i < 1000 else "user_name: <secret>, key <secret>")


def test_repeated_rows_and_ids(documents):
    rows = [(1, "token = abcdefgh1"), (1, "token = abcdefgh1"), (1, "nothing"), (None, "AKIA" + "Z" * 16)]
    got = sorted((r["doc_id"] or 0, r["n_assign"], r["n_access"]) for r in _digest(documents(rows)).collect())
    assert got == [(0, 0, 1), (1, 0, 0), (1, 1, 0), (1, 1, 0)]


def test_masking(documents):
    docs = documents([(1, "a token = abcdefgh1 b"), (2, "clean"), (3, None)], extra=True)
    got = {r["doc_id"]: r for r in mask_secrets(docs).collect()}
    assert got[1]["text"] == "a <secret> b" and got[1]["n_chars"] == len("a <secret> b")
    assert got[2]["text"] == "clean" and got[3]["text"] is None and got[1]["spans"] == "clash"
    assert mask_secrets(docs).columns == docs.columns


def test_empty(documents):
    assert _digest(documents([])).count() == 0


def test_very_long_text(documents):
    filler = "plain words of no interest " * 40_000
    rows = [(1, filler + "user: annabel token = abcdefgh1 " + filler), (2, "Q" * 300_000 + "z1" * 300_000)]
    got = {r["doc_id"]: r for r in _digest(documents(rows)).collect()}
    assert got[1]["n_assign"] == 1 and "weak_id" in got[1]["spans"] and got[2]["spans"] == ""
