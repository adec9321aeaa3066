"""Cleaning, dictionaries, encoding, union."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.functions.text import (
    WHITESPACE, length_bin, residue_counts, spaced, stratum_key, strip)
from strandline.operators import vocab
from strandline.operators.clean import CHAINS, clean_rejects, clean_route
from strandline.operators.encode import encode_tokens, residue_tokens
from strandline.operators.union import mixed_union, sample_group

RECORDS = "row_id int, Sequence string, Fatty_acid_chain string"


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("text", ["\tKLA\n", "  KLA\x0b", "\x1cKLA\x85", " KLA　", "KLA"])
def test_strip_like_python(spark, text):
    assert one(spark, strip, text) == text.strip() == "KLA"


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_spaced(spark):
    assert one(spark, spaced, "KLA") == "K L A"
    assert one(spark, spaced, "K\U0001F9ECß") == "K \U0001F9EC ß"


@pytest.mark.parametrize("length, expected", [
    (0, 0), (9, 0), (10, 1), (189, 18), (190, None), (-1, None), (None, None)])
def test_length_bin(spark, length, expected):
    assert one(spark, length_bin, length, "int") == expected


def test_stratum_key_is_null_without_category(spark):
    rows = spark.createDataFrame([("C6", 1), (None, 0)], "c string, y int")
    assert [r[0] for r in rows.select(stratum_key(F.col("c"), F.col("y"))).collect()] == ["C6_1", None]


def test_residue_counts(spark):
    rows = spark.createDataFrame([("KLKA",), ("",), (None,)], "x string")
    got = [r[0] for r in rows.select(residue_counts(F.col("x"), "AKL")).collect()]
    assert got == [[1.0, 2.0, 1.0], [0.0, 0.0, 0.0], None]


def test_residue_counts_take_little_memory_beside_long_texts(monkeypatch):
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda function: lambda column: function)
    count = residue_counts(None, "AKL")
    texts = pa.array([None, "K" * 700_001 + "A", "", "é" * 400_000 + "LL", *["xAKL" * 1_000] * 500])
    tracemalloc.start()
    got = count(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:4].to_pylist() == [None, [1.0, 700_001.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 2.0]]
    assert got[4:].to_pylist() == [[1_000.0] * 3] * 500
    assert peak < 4 * texts.nbytes


def test_residue_counts_memory_does_not_grow_with_the_batch(monkeypatch):
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda function: lambda column: function)
    count = residue_counts(None, "abcdefghijklmnopqrstuvwxyz")
    peaks = []
    for times in (1, 8):
        texts = pa.array(["the lazy dog " * 5_000 * times] * 10)
        tracemalloc.start()
        assert count(texts)[9].as_py()[4] == 5_000 * times
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_residue_counts_of_null_slots_and_slices(monkeypatch):
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda function: lambda column: function)
    count = residue_counts(None, "AKL")
    held = pa.Array.from_buffers(pa.string(), 3, [pa.py_buffer(b"\x05"), pa.array([0, 2, 4, 6], pa.int32()).buffers()[1],
                                                  pa.py_buffer(b"AAKKLL")])  # the null in the middle holds KK
    assert count(held).to_pylist() == [[2.0, 0.0, 0.0], None, [0.0, 0.0, 2.0]]
    assert count(held.slice(2)).to_pylist() == [[0.0, 0.0, 2.0]]
    assert count(held.slice(0, 0)).to_pylist() == [] and count(pa.nulls(2, pa.string())).to_pylist() == [None, None]


def test_clean_route(spark):
    rows = spark.createDataFrame([
        (0, " KLA ", " c12 "), (1, "KL", "C0"), (2, "KL", "C7"), (3, "KL", None), (4, None, "C6"),
        (5, "", "C18")], RECORDS)
    good = {r.row_id: r for r in clean_route(rows).collect()}
    assert {i: (r.clean_sequence, r.input_category, r.routed_category) for i, r in good.items()} == {
        0: ("KLA", "C12", "C12"), 1: ("KL", "C0", "NULL"), 5: ("", "C18", "C18")}
    assert good[0].Sequence == " KLA " and good[0].Fatty_acid_chain == " c12 "
    bad = {r.row_id: r.reason for r in clean_rejects(rows).collect()}
    assert bad == {2: "invalid category", 3: "null category", 4: "null sequence"}


def test_static_vocab(spark):
    rows = vocab.static_vocab(spark, CHAINS[1:]).collect()
    assert {r.value: r.idx for r in rows} == {
        "C10": 0, "C12": 1, "C14": 2, "C16": 3, "C18": 4, "C6": 5, "C8": 6, "<UNK>": 7, "NULL": 8}


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_built_vocab_equals_static_one(spark, hot_rows):
    data = spark.createDataFrame([(c,) for c in CHAINS[1:] * 3] + [(None,)], "c string")
    built = vocab.build_vocab(data, "c", hot_rows).collect()
    static = vocab.static_vocab(spark, CHAINS[1:]).collect()
    assert sorted(map(tuple, built)) == sorted(map(tuple, static))


def test_category_index_default(spark):
    rows = spark.createDataFrame([("C6",), ("c6",), (None,), ("NULL",)], "c string")
    got = vocab.category_index(rows, "c", vocab.static_vocab(spark, CHAINS[1:]))
    assert {r.c: r.chain_index for r in got.collect()} == {"C6": 5, "c6": 7, None: 7, "NULL": 8}


def test_category_index_without_unknown_falls_to_zero(spark):
    words = spark.createDataFrame([("a", 3)], "value string, idx int")
    got = vocab.category_index(spark.createDataFrame([("b",)], "c string"), "c", words)
    assert got.first().chain_index == 0


TOKENS = [("K", 12), ("L", 5)]


@pytest.mark.parametrize("text, max_len, ids, mask", [
    ("KLZ", 6, [2, 12, 5, 1, 3, 0], [1, 1, 1, 1, 1, 0]),
    ("KLKLK", 5, [2, 12, 5, 12, 3], [1] * 5),
    ("", 4, [2, 3, 0, 0], [1, 1, 0, 0]),
    ("   \t" * 50 + "K L", 6, [2, 12, 5, 3, 0, 0], [1, 1, 1, 1, 0, 0]),
    ("K​ L  ", 5, [2, 12, 5, 3, 0], [1, 1, 1, 1, 0]),
])
def test_encode(spark, text, max_len, ids, mask):
    rows = spark.createDataFrame([(text,)], "s string")
    tokens = spark.createDataFrame(TOKENS, "token string, id int")
    got = encode_tokens(rows, "s", tokens, max_len).first()
    assert (got.input_ids, got.attention_mask) == (ids, mask)
    assert len(got.input_ids) == max_len


def test_encode_long_window(spark):
    rows = spark.createDataFrame([("K " * 5000,)], "s string")
    got = encode_tokens(rows, "s", residue_tokens(spark), 2000).first()
    assert got.input_ids == [2] + [12] * 1998 + [3] and sum(got.attention_mask) == 2000


def test_mixed_union(spark):
    lipo = spark.createDataFrame([("KL", "C6", 1), ("KA", "C99", 0)],
                                 "Sequence string, Fatty_acid_chain string, Label int")
    plain = spark.createDataFrame([("A", 1), ("L", 0), ("K", 0)], "Sequence string, Label long")
    rows = mixed_union(lipo, plain, vocab.static_vocab(spark, CHAINS[1:])).withColumn(
        "g", sample_group(F.col("Fatty_acid_chain"), F.col("Label"), F.col("is_lipo"))).collect()
    assert {r.Sequence: (r.is_lipo, r.chain_index, r.Label, r.g) for r in rows} == {
        "KL": (1.0, 5, 1, "C6_1"), "KA": (1.0, 7, 0, "C99_0"), "A": (0.0, 8, 1, "Linear_1"),
        "L": (0.0, 8, 0, "Linear_0"), "K": (0.0, 8, 0, "Linear_0")}
