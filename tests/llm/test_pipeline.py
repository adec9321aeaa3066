"""The pipeline's stages, each against what it must keep, change and return."""

import random

import corpus_pipeline
from test_jaccard import family, groups_of
from test_tokens import check_places


def test_stages(spark, shared):
    rng = random.Random(9)
    texts = [None, "", "12 34", "das haus ist alt", "pwd: x7Kq9ZrT2m end of it"] + family(rng, 30, 80, 6) + [
        " ".join(f"u{rng.randint(0, 10 ** 6)}" for _ in range(40)) for _ in range(10)]
    rows = [(i, t, "en", "s", len(t or ""), "own", 7) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 1, "own", 7),
                                                                                   (None, "no key here", "en", "s", 1, "own", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, n int")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    known, kept, masked, packed = (stage for _, stage in corpus_pipeline.STAGES)

    docs = known(spark, docs, "")
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "n"]
    first = docs.collect()
    assert len(first) == len(rows) - 3 and {r.spans for r in first} == {"own"}

    docs = kept(spark, spark.createDataFrame(first, docs.schema), "")
    second = docs.collect()
    groups = groups_of(texts, 5, 80)
    expected = sorted({g for i, _, g in groups if i > 2})
    assert sorted(r.doc_id for r in second if r.doc_id is not None) == expected and len(second) == len(expected) + 1

    docs = masked(spark, spark.createDataFrame(second, docs.schema), "")
    third = {r.doc_id: r for r in docs.collect()}
    assert third[4].text == "pwd: [SECRET] end of it" and third[4].n_chars == len(third[4].text) and third[4].spans == "own"
    assert all(third[r.doc_id].text == r.text and third[r.doc_id].n_chars == r.n_chars for r in second if r.doc_id != 4)

    rows = packed(spark, docs, "").collect()
    assert len({r.doc_id for r in rows}) == len(second) and check_places(rows, 2048) >= 1


def test_no_documents(spark, shared):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []


def test_run_from_files(spark, shared, tmp_path):
    spark.createDataFrame([(1, "the text", "en", "s", 8), (2, "the text", "en", "s", 8)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/t/documents.parquet")
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    assert [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/t").collect()] == [1]
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == before


def test_texts_of_repeated_ids_are_judged_apart(spark, shared):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(7, a), (8, a), (7, b), (9, b), (10, c), (10, c), (None, a), (7, None), (7, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [(7, a), (7, b), (10, c), (None, a), (7, None), (7, "")], key=repr)
