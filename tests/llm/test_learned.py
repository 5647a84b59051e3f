"""Language ID and toxicity: held-out quality, and awkward rows."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import DOCS, awkward
from textgate.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.op5_language_id(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    judged = [r for r in out if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in judged]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, "x") for r in awkward()], DOCS + ", lang_pred string")
    out = langid.identify(docs, langid.train(docs))
    assert out.columns == [c for c in docs.columns if c != "lang_pred"] + ["lang_pred", "lang_score", "lang_rejected"]
    for r in out.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.lang_score, r.lang_rejected) == ("und", 0.0, True)


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None, "w", 9)], DOCS)
    assert [r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()] == ["und"]
    empty = spark.createDataFrame([], DOCS)
    assert langid.identify(empty, langid.train(empty)).count() == 0


def test_language_of_a_long_text_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    model = langid.LanguageModel(["a", "b"], rng.normal(size=(langid.BUCKETS + 1, 3)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    texts = ["Eine Straße über İstanbul. " * 9, "x", "", "?!"]
    whole, has = model.logits(texts)
    monkeypatch.setattr(langid, "PART_CHARS", 7)
    parts, has_too = model.logits(texts)
    assert np.allclose(whole, parts, rtol=1e-5) and list(has) == list(has_too) == [True, True, False, False]


def auc(score, label):
    score, label = np.array(score), np.array(label)
    order = score.argsort(kind="stable")
    ranks = np.empty(len(score))
    for s in np.unique(score):
        ranks[score == s] = (np.flatnonzero(np.sort(score) == s) + 1).mean()
    assert len(order)
    n1 = label.sum()
    return (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(F.col("toxic").isNotNull())
    out = toxicity.op9_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert auc([r.score for r in out], [r.toxic for r in out]) > 0.85
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.9


def test_toxicity_of_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, 7) for r in awkward()], DOCS + ", toxicity int")
    none = spark.createDataFrame([(None, None), (1, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(out) == len(awkward()) and all(0 <= r.toxicity <= 1 for r in out)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


def test_grammar_weighs_intent_and_reports():
    model = toxicity.ToxicityModel({"idiot": 2.0}, {}, toxicity.PRIOR)
    model.features("kill")
    run = lambda text: [x for x in model._machine.run([t if model._known(t) else "other" for t in text.split()]) if x[0] != "other"]
    assert run("kill") == [("threat", 1.0)]
    assert ("threat", toxicity.INTENDED) in run("i will surely kill")
    assert run("you idiot")[1] == ("aimed insult", 2.0 * toxicity.AIMED)
    assert run("not an idiot")[1] == ("negated insult", 2.0 * toxicity.NEGATED)
    assert run("he said idiot")[-1] == ("reported insult", 2.0 * toxicity.REPORTED)


@pytest.mark.parametrize(
    "low, high",
    [
        ("you are not an idiot", "you are an idiot"),
        ("He said \"you are an idiot\"", "you are an idiot"),
        ("the idiot of the novel", "you are an idiot"),
    ],
)
def test_grammar_matches_clauses(low, high):
    model = toxicity.ToxicityModel({"idiot": 1.0}, {}, toxicity.PRIOR)
    assert model.score(low) < model.score(high)


@pytest.mark.parametrize("text", ["", "kill " * 50_000, "you idiot. " * 20_000])
def test_grammar_on_long_texts(text):
    model = toxicity.ToxicityModel({"idiot": 1.0}, {}, toxicity.PRIOR)
    assert 0 <= model.score(text) <= 1
