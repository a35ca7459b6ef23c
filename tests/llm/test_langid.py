import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadtime.llm import langid as L

WORDS = {"en": "the house and window with light over there", "de": "das haus und fenster mit licht dort drüben",
         "fr": "la maison et fenêtre avec lumière là bas"}


def sample(spark):
    rows = []
    for k in range(240):
        lang = list(WORDS)[k % 3]
        w = WORDS[lang].split()
        rows.append((k, " ".join(w[(k * j) % len(w)] for j in range(1, 12)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("n", [2, 4, 6, 9, 25])
def test_codewords_tell_languages_apart(n):
    c = L.codewords(n)
    assert c.shape[0] == n and (c.sum(0) > 0).all() and (c.sum(0) < n).all()
    assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def test_features_stay_within_their_text():
    bins, owner, has = L.features(["ab", None, "12 !", "Ab"])
    assert has.tolist() == [True, False, False, True]
    of = lambda k: sorted(bins[owner == k].tolist())
    assert of(0) == of(3) and len(of(0)) == 2 + 3 + 2 + 1 and of(1) == [] and of(2) == []


def test_held_out_accuracy_and_no_use_of_held_out_labels(spark):
    docs = sample(spark)
    got = L.language_table(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred != lang").count() == 0
    assert got.where("held_out").count() > 0 and got.where("score < 0 or score > 1").count() == 0
    wrong = docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in L.language_table(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in L.language_table(wrong).collect()}


def test_query_on_given_documents(spark, sf):
    from leadtime.llm.catalog import QUERIES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op3_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    assert got.where("held_out and lang_pred = lang").count() >= 0.97 * got.where("held_out and lang is not null").count()


def test_odd_rows(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in L.language_table(odd_docs.withColumnRenamed("source", "lang_pred")).collect()}
    assert {got[k].lang_pred for k in (1, 2, 3, 6)} == {"und"} and {got[k].score for k in (1, 2, 3, 6)} == {0.0}
    assert got[7].lang_pred == "en" and got[7].score == 1.0  # the only label there is
    assert L.language_table(no_docs).count() == 0
    none = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.language_table(none).collect()} == {"und"}
    kept = L.keep_identified(odd_docs, L.learn(odd_docs))
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "5", "7", "8", "None"]


def test_ambiguous_is_flagged():
    model = L.LanguageModel(["a", "b"], np.array([[0], [1]], np.int8), np.zeros((L.BINS, 1)), np.ones(1))
    lang, score, lead = model.predict(["xyz", None])
    assert lang == ["a", "und"] and score == [0.5, 0.0] and lead == [0.0, 0.0]


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(L, "SLICE_CHARS", 10)
    texts = ["abc def ghi jkl mno", None, "", "xy", "z" * 35]
    got = list(L.pieces(texts))
    assert all(sum(len(p or "") for p in part) <= 10 for part, _ in got)
    whole = {}
    for part, of in got:
        for p, k in zip(part, of.tolist(), strict=True):
            whole[k] = whole.get(k, "") + (p or "")
    assert whole == {k: t or "" for k, t in enumerate(texts)}


def test_nothing_to_learn_keeps_texts_with_letters(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F
    for docs in (odd_docs.withColumn("lang", F.lit(None).cast("string")), odd_docs):
        kept = L.keep_identified(docs, L.learn(docs.withColumn("lang", F.lit(None).cast("string"))))
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "5", "7", "8", "None"]
    assert L.keep_identified(no_docs, L.learn(no_docs)).count() == 0


def slow_decode(model, text):
    """Loss-weighted decoding, one n-gram and one bit at a time."""
    bins, owner, has = L.features([text])
    side = [sum(float(model.weights[x, b]) for x in bins) / max(len(bins), 1) ** 0.5 for b in range(model.code.shape[1])]
    loss = {}
    for k, name in enumerate(model.languages):
        loss[name] = sum(math.log1p(math.exp(-s * (1 if bit else -1))) * r for s, bit, r in zip(side, model.code[k], model.reliability, strict=True))
    low = min(loss.values())
    total = sum(math.exp(low - v) for v in loss.values())
    best = min(loss, key=lambda n: (loss[n], n))
    return best, math.exp(low - loss[best]) / total


def test_decoding_equals_a_plain_decoder(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.learn(docs)
    rows = docs.where("length(text) between 1 and 4000").select("text").limit(60).collect()
    names, scores, _ = model.predict([r.text for r in rows])
    for r, name, score in zip(rows, names, scores, strict=True):
        if any(c.isalpha() for c in r.text):
            want, share = slow_decode(model, r.text)
            assert name == want and abs(score - share) < 1e-3
