import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelsplit.llm.packing import Capacities, Encoder, default_tokenizer, pack_documents, plan_packing


def _check(rows, docs, capacity=1024):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    got = pack_documents(docs).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == capacity for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in got)


def test_round_trip_and_gapless_sequences(documents):
    rng = random.Random(1)
    odd = ["", None, " ", "a  b", "x\n\ny", "  lead", "tail ", "tab\tend", "é ü ñ", "don't we'll  'tis", "<|endoftext|> here", "\n", "a \n b", "日本 語", "word " * 3000]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, " ".join(rng.choices(["the", "Their,", "of", "naïve", "end.\nNew", "12,5"], k=rng.randint(1, 900)))) for i in range(120)]
    used, tokens = _check(rows, documents(rows, extra=True))
    assert used <= 1.02 * tokens / 1024 + 1


def test_encoder_gives_the_ids_of_the_tokenizer():
    encoder, tokenizer = Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())

    def same(text):
        return np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids

    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices([" ", "a", "Ab", "'s", "\n", "1", "é", ".", "!!", "\u3000", "_", "\t", "<|endoftext|>", "<|end", "\x85", "日"], k=rng.randint(0, 25)))
        assert same(text), repr(text)
    for first in range(0, 0x30000, 64):
        around = (chr(c) for c in range(first, first + 64) if not 0xD800 <= c < 0xE000)
        text = " ".join(f"a{c}b 1{c} {c}{c}! {c}" for c in around)
        assert same(text), hex(first)


def test_special_tokens_count_as_such(documents):
    r = pack_documents(documents([(1, "a <|endoftext|> b")])).collect()[0]
    assert r["length"] == 5 and r["ids_crc32"] == zlib.crc32(np.array([64, 220, 50256, 275, 2], "<u4").tobytes())


def test_plan_keeps_every_capacity():
    rng = random.Random(2)
    histogram = collections.Counter(rng.randint(1, 100) for _ in range(3000))
    for caps in (Capacities(100, 3, 5000), Capacities(100, 100, 100 * 100), Capacities(128, 4, 128 * 128)):
        if caps.attention < 100 * 100:
            with pytest.raises(ValueError):
                plan_packing(dict(histogram), caps)
            caps = caps._replace(attention=10_000)
        for fit in ("norm", "dot"):
            bins, placed = collections.defaultdict(list), collections.Counter()
            for s in plan_packing(dict(histogram), caps, fit=fit):
                placed[s.length] += s.bins
                for k in range(s.bins):
                    bins[s.sequence + k].append((s.offset, s.length))
            assert placed == histogram
            for b in bins.values():
                lengths = [x for _, x in b]
                assert sum(lengths) <= caps.tokens and len(b) <= caps.documents and sum(x * x for x in lengths) <= caps.attention
                assert [o for o, _ in sorted(b)] == [sum(x for _, x in sorted(b)[:i]) for i in range(len(b))]


def test_repeated_rows_and_empty(documents):
    got = pack_documents(documents([(1, "same text"), (1, "same text"), (None, "x")])).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3
    assert pack_documents(documents([])).count() == 0
