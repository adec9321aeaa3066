"""Language ID: spans of mixed texts, accuracy on texts not learned from, edges of the domain."""

import itertools
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_tables import TABLES, text_rows
from strandline.llm import language


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-4, 5, (rng.integers(1, 6), rng.integers(1, 4))).astype(float)
        path = language.viterbi(scores, 2.0)

        def worth(p):
            return sum(scores[t, x] for t, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))

        best = max(map(worth, itertools.product(range(scores.shape[1]), repeat=len(scores))))
        assert worth(path) == best


def test_held_out_accuracy(spark, shared):
    docs = spark.read.parquet(str(TABLES / "documents.parquet"))
    model = language.fit(language.training_rows(docs))
    rows = language.predict(docs, model).where(language.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_scripts_and_edges(spark, shared):
    train = spark.createDataFrame(
        [("the house and the garden with the tree", "en"), ("das haus und der garten mit dem baum", "de"),
         ("дом и сад с деревом", "ru"), (None, "en"), ("nothing", None)] * 5, "text string, lang string")
    model = language.fit(train)
    assert model.langs == ["de", "en", "ru"]
    texts = ["the garden and the tree with the house das haus und der garten mit dem baum", "дом", None, "",
             "12 34 !?", "漢字", "the garden İ", "x" * 50_000]
    got = language.predict(text_rows(spark, texts, extra=True), model, penalty=5.0).orderBy("doc_id").collect()
    assert [s["lang"] for s in got[0].spans] == ["en", "de"]
    assert texts[0][got[0].spans[1]["start"]:got[0].spans[1]["end"]] == "das haus und der garten mit dem baum"
    assert [r.lang_pred for r in got[1:6]] == ["ru", "und", "und", "und", "de"] and got[5].score == 0
    assert got[6].lang_pred == "en" and got[7].lang_pred in model.langs and got[0].n == 1
    empty = language.fit(train.limit(0))
    assert {r.lang_pred for r in language.predict(text_rows(spark, texts), empty).collect()} == {"und"}
    assert language.predict(text_rows(spark, texts).limit(0), model).collect() == []


def test_languages_of_one_repeated_text(spark, shared):
    texts = {"en": "the house and the garden", "de": "das haus und der garten", "fr": "la maison et le jardin",
             "es": "la casa y el jardín que", "ru": "дом и сад с деревом"}
    rows = [(t, lang) for lang, t in texts.items() for _ in range(3000)] + [("another text of many", "en")] * 2
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=1)
    assert model.langs == sorted(texts) and model.candidates.any(0).all()
    got = language.predict(text_rows(spark, list(texts.values())), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == list(texts) and all(r.score > 0 for r in got)


def test_too_many_languages(spark, shared, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    rows = spark.createDataFrame([("abc", f"l{i}") for i in range(4)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.fit(rows)


def test_broadcast_needs_no_package(spark, shared, monkeypatch):
    model, sent = language.fit(spark.createDataFrame([("abc def", "x")], "text string, lang string")), []
    context = type(spark.sparkContext)
    plain = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(value) or plain(self, value))
    assert language.predict(text_rows(spark, ["abc"]), model).first().lang_pred == "x"
    assert len(sent) == 1 and b"strandline" not in pickle.dumps(sent[0])
