import numpy as np
import pytest
from pyspark.sql import functions as F

from panelsplit.llm.common import id_remainder, table
from panelsplit.llm.langid import fit_languages, op7_language_id, predict_languages
from panelsplit.llm.quality import fit_quality, op5_quality_classifier, score_quality
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = op5_quality_classifier(spark, SF).join(table(spark, SF, "labels").select("doc_id", "quality"), "doc_id", "left").toPandas()
    assert len(got) == table(spark, SF, "documents").count() and got["score"].between(0, 1).all()
    assert all(h == (brute.remainder(i, 4) == 2) for i, h in zip(got["doc_id"], got["held_out"]))
    assert ((got["score"] >= 0.7).astype(int) == got["predicted"]).all()
    test = got[got["held_out"] & got["quality"].notna()]
    good, bad = test[test["quality"] == 1]["score"].to_numpy(), test[test["quality"] == 0]["score"].to_numpy()
    auc = np.mean([(good > b).mean() + 0.5 * (good == b).mean() for b in bad])
    assert auc > 0.85 and (good >= 0.7).mean() > 0.9


def test_languages_on_held_out_rows(spark):
    got = op7_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert all(h == (brute.remainder(i, 3) == 1) for i, h in zip(got["doc_id"], got["held_out"]))
    test = got[got["held_out"]]
    assert (test["lang"] == test["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_answers_without_learning(spark, documents):
    docs = documents([(1, "some text"), (2, None), (3, ""), (3, "")], extra=True)
    none = docs.limit(0).withColumn("quality", F.lit(1))
    assert {r["score"] for r in score_quality(docs, fit_quality(docs, none), "doc_id").collect()} == {0.5}
    one_class = docs.withColumn("quality", F.lit(1))
    assert {r["score"] > 0.5 for r in score_quality(docs, fit_quality(docs, one_class), "doc_id").collect()} == {True}
    assert {r["lang_pred"] for r in predict_languages(docs, fit_languages(docs.limit(0)), "doc_id").collect()} == {"und"}


def test_language_of_odd_texts(documents):
    train = documents([(i, t, l) for i, (t, l) in enumerate([("the thing that was there and then", "en"), ("und der die das nicht ein", "de"), ("x", None), (None, "fr"), ("y", "")] * 3)])
    model = fit_languages(train)
    assert set(model) == {"en", "de"}
    odd = documents([(1, None), (2, ""), (3, "123 !!"), (4, "ß"), (5, "THE THING THAT WAS"), (6, "Nicht ein. " * 5000)], extra=True)
    got = {r["doc_id"]: r for r in predict_languages(odd, model, "doc_id").collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in model
    assert got[5]["lang_pred"] == "en" and got[6]["lang_pred"] == "de" and not got[1]["accepted"] and got[6]["accepted"]


def test_quality_of_odd_texts(documents):
    rows = [(i, "a clean line of words number %d" % i if i % 2 else "!!! $$$ *** ### %d" % i) for i in range(200)]
    docs = documents(rows)
    model = fit_quality(docs, docs.withColumn("quality", (F.col("doc_id") % 2).cast("int")))
    odd = documents([(1, None), (2, ""), (3, "a clean line of words"), (4, "!!! $$$ *** ###"), (5, "words of a line " * 30_000)], extra=True)
    got = {r["doc_id"]: r["score"] for r in score_quality(odd, model, "doc_id").collect()}
    assert got[1] == got[2] and got[3] > got[4] and all(0 <= s <= 1 for s in got.values())


@pytest.mark.parametrize("query", [op5_quality_classifier, op7_language_id])
def test_null_ids_are_not_held_out(documents, query):
    assert documents([(None, "x")]).select(F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("h")).collect()[0]["h"] is False
