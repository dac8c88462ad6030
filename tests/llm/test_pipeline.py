import collections

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from panelsplit.llm.common import store, table
from panelsplit.llm.decontam import edit_bound, least_edits, normal_words
from panelsplit.llm.packing import default_tokenizer
from panelsplit.llm.quality import fit_quality, learnable, score_quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_every_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    was, out = docs, {}
    for name in list(stages)[:-1]:
        out[name] = store(stages[name](spark, was, SF), f"test-{name}")
        assert out[name].columns == docs.columns
        was = out[name]
    texts = {"documents": _texts(docs), **{name: _texts(df) for name, df in out.items()}}

    scores = {r["doc_id"]: r["score"] for r in score_quality(docs, fit_quality(docs, learnable(table(spark, SF, "labels"))), "doc_id").collect()}
    assert set(texts["quality"]) == {i for i, s in scores.items() if s >= 0.7}

    groups = brute.components(sorted(texts["quality"].items()), 5)
    assert set(texts["near_duplicates"]) == {i for i, (_, c) in groups.items() if i == c}

    items = [normal_words(r["text"]) for r in table(spark, SF, "benchmark").collect()]

    def leaked(text):
        words = normal_words(text)
        return any(least_edits(item, words)[0] <= edit_bound(len(item), 0.2) for item in items if len(item) >= 5)

    assert set(texts["decontamination"]) == {i for i, t in texts["near_duplicates"].items() if not leaked(t)}

    assert set(texts["secrets"]) == set(texts["decontamination"])
    for i, text in texts["decontamination"].items():
        assert not brute.secret_bases(texts["secrets"][i].replace("<secret>", "\n"))
        assert texts["secrets"][i] == text or brute.secret_bases(text)

    packed = stages["packing"](spark, out["secrets"], SF).collect()
    tokenizer, pieces, bins = Tokenizer.from_file(default_tokenizer()), collections.Counter(), collections.Counter()
    for r in packed:
        pieces[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]] += r["length"]
    assert pieces == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts["secrets"].items()}
    assert max(bins.values()) <= 1024 and len(bins) <= np.ceil(1.02 * sum(bins.values()) / 1024) + 1


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_stages_on_odd_rows(spark, documents):
    rows = [(1, None), (1, None), (2, ""), (3, "token = abcdefgh1"), (3, "token = abcdefgh1"), (None, "a text without an id"), (4, "long " * 40_000)]
    docs = documents(rows, extra=True)
    empty = documents([], extra=True)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, empty, SF)
        assert none.count() == 0
        if name != "packing":
            assert out.columns == docs.columns and {r["kind"] for r in out.collect()} <= {"clash"}
        if name in ("decontamination", "secrets"):
            assert out.count() == len(rows)
        if name == "near_duplicates":  # one of equal rows stays
            assert out.count() == len(set(rows))
