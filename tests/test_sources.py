"""Readers, writers, models on disk, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators.clean import clean_route
from strandline.operators.history import best_checkpoint
from strandline.plans.scoring import score_records
from strandline.sources import models, tables
from strandline.streaming.files import run_on_arrival, stream_table

PEPTIDES = """Peptide_No,Sequence,Fatty_acid_chain,Label,Length
P_1,KLAK,C12,1,4
P_2,KK,C6,0,2
P_3,NA,C0,1,2
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in.csv").write_text(PEPTIDES)
    return tmp_path


def test_read_csv(spark, folder):
    rows = tables.read_table(spark, str(folder / "in.csv"))
    assert dict(rows.dtypes)["Label"] == "int" and rows.count() == 3
    typed = tables.read_peptides(spark, str(folder / "in.csv"))
    assert typed.columns[0] == "peptide_id"
    assert [r.Sequence for r in typed.orderBy("peptide_id").collect()] == ["KLAK", "KK", "NA"]


@pytest.mark.parametrize("suffix", [".csv", ".CSV", ".parquet", ".json"])
def test_round_trip(spark, tmp_path, suffix):
    rows = spark.createDataFrame([(1, 'say "hi", K'), (2, "L")], "n int, s string")
    path = str(tmp_path / f"out{suffix}")
    tables.write_table(rows, path)
    tables.write_table(rows, path)
    back = tables.read_table(spark, path, rows.schema)
    assert sorted(map(tuple, back.select("n", "s").collect())) == [(1, 'say "hi", K'), (2, "L")]


def test_unknown_suffix(spark):
    for path in ("x.xlsx", "predictions"):
        with pytest.raises(ValueError, match="unknown table format"):
            tables.read_table(spark, path)


def test_required_columns(spark):
    rows = spark.createDataFrame([("K",)], "Sequence string")
    assert tables.require_columns(rows, ["Sequence"]) is rows
    with pytest.raises(ValueError, match="Label.*Length"):
        tables.require_columns(rows, tables.TRAINING_COLUMNS)


def test_models_replace_only_their_fold(spark, tmp_path):
    path = str(tmp_path / "models")

    def save(fold, value):
        rows = models.model_rows(fold, {"w": np.full((2, 2), value), "b": np.array([value])})
        models.save_fold(spark.createDataFrame(rows, models.MODEL_SCHEMA), path)

    save(0, 1.0), save(1, 2.0), save(0, 3.0)
    back = models.read_models(spark, path)
    assert models.list_folds(back) == [0, 1]
    loaded = models.load_folds(back)
    assert loaded[0]["w"].tolist() == [[3.0, 3.0], [3.0, 3.0]] and loaded[1]["b"].tolist() == [2.0]
    with pytest.raises(ValueError, match="no fold model"):
        models.list_folds(back.where("fold > 5"))


def test_history_log(spark, tmp_path):
    path = str(tmp_path / "history")
    for epoch, value in enumerate((.1, .4, .3)):
        tables.append_history(spark.createDataFrame(
            [("r", 0, epoch, "MCC/Val", value)],
            "run string, fold int, epoch int, tag string, value double"), path)
    best = best_checkpoint(spark.read.parquet(path), ["run", "fold"]).first()
    assert (best.best_epoch, best.best_value, best.stop_epoch) == (1, .4, None)


def test_stream_gives_the_batch_result(spark, tmp_path):
    schema = "n int, Sequence string, Fatty_acid_chain string, x array<double>"
    rows = spark.createDataFrame(
        [(i, " K ", c, [float(i), 1.0]) for i, c in enumerate(["C6", "c8 ", "C7", "C0", None])], schema)
    heads = spark.createDataFrame(models.model_rows(0, {
        "head.weight": np.array([[0.0, 0.0], [0.3, -0.5]]), "head.bias": np.zeros(2)}),
        models.MODEL_SCHEMA)
    source, out, log = (str(tmp_path / n) for n in ("in", "out.parquet", "log"))
    for part in (rows.where("n < 2"), rows.where("n >= 2")):
        part.write.mode("append").parquet(source)
        query = run_on_arrival(stream_table(spark, source, schema),
                               lambda d: score_records(d, [F.col("x")], heads), out, log)
        assert query.awaitTermination(120) and query.exception() is None
    batch = score_records(rows, [F.col("x")], heads)
    assert sorted(map(tuple, spark.read.parquet(out).select("n", "Probability").collect())) == sorted(
        map(tuple, batch.select("n", "Probability").collect()))
    assert batch.count() == 3


def test_stream_of_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(PEPTIDES)
    schema = tables.PEPTIDE_SCHEMA
    query = run_on_arrival(stream_table(spark, str(tmp_path / "in"), schema, "csv"), clean_route,
                           str(tmp_path / "o.parquet"), str(tmp_path / "log"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "o.parquet")).collect()
    assert {r.peptide_id: r.routed_category for r in got} == {"P_1": "C12", "P_2": "C6", "P_3": "NULL"}
