"""Training pipelines on a separable toy set."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.text import length_bin, residue_counts
from strandline.operators.vocab import category_index, static_vocab
from strandline.plans import training
from strandline.plans.scoring import score_file
from strandline.sources.tables import read_history, read_table, write_table

LETTERS = "AKL"


@pytest.fixture(scope="module")
def peptides(spark):
    draw = random.Random(1)
    rows = []
    for i in range(240):
        y = i % 2
        text = "".join(draw.choice("KKKA" if y else "LLLA") for _ in range(draw.randint(5, 25)))
        rows.append((f"P{i}", text, draw.choice(["C6", "C8"]), y, len(text)))
    df = spark.createDataFrame(
        rows, "id string, Sequence string, Fatty_acid_chain string, Label int, Length int")
    return category_index(df, "Fatty_acid_chain", static_vocab(spark, ["C6", "C8"])).withColumn(
        "counts", residue_counts(F.col("Sequence"), LETTERS))


def test_fold_weights(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("b", None), ("c", 0)], "g string, f int")
    got = {(r.g, r.f): r.w for r in training.fold_weights(rows, "g", "f", 2, "w").collect()}
    assert got["a", 0] == [0.5, 1.0] and got["b", None] == [1.0, 1.0] and got["c", 0] == [None, 1.0]


def test_train_kfold(spark, peptides, tmp_path):
    lipo, plain = peptides.where("id < 'P5'"), peptides.where("id >= 'P5'").drop("Fatty_acid_chain")
    run = training.train_kfold(lipo, "id", F.col("counts"), "Fatty_acid_chain", "chain_index", 4,
                               "Label", plain=plain, k=3, grid=(0.01, 0.1))
    report = run.report.collect()
    n, extra = lipo.count(), plain.count()
    assert [r.fold for r in report] == [0, 1, 2] and sum(r.val_rows for r in report) == n
    assert all(r.train_rows + r.val_rows == n + extra for r in report)
    assert all(r.mcc > 0.8 and r.auc > 0.95 for r in report)
    assert run.history.where("tag = 'mcc'").count() == 6
    assert training.save_training(run, str(tmp_path)) == [0, 1, 2] and training.save_training(run, str(tmp_path)) == []
    assert read_history(spark, str(tmp_path / "history")).where("tag = 'mcc'").count() == 6
    ready = str(tmp_path / "ready.parquet")
    lipo.withColumn("x", training.with_category(F.col("counts"), F.col("chain_index"), 4)).drop(
        "counts").write.parquet(ready)
    scored = str(tmp_path / "scored.csv")
    score_file(spark, str(tmp_path / "models"), ready, ["x"], scored)
    back = read_table(spark, scored)
    assert back.columns == [*[c for c in lipo.columns if c != "counts"], "Probability", "Prediction"]
    assert back.count() == n and back.where("Prediction = Label").count() > 0.95 * n


def test_train_holdout(spark, peptides, tmp_path):
    stratum = F.concat_ws(" ", "Label", length_bin(F.col("Length")))
    run = training.train_holdout(peptides, "id", F.col("counts"), "Label", stratum, grid=(0.01,))
    report = run.report.collect()
    assert len(report) == 1 and report[0].mcc > 0.8
    assert set(run.report.columns) == {"acc", "mcc", "f1", "auc", "pr_auc", "recall", "precision"}
    write_table(run.report, str(tmp_path / "test_results.csv"))
    given = training.train_holdout(peptides, "id", F.col("counts"), "Label", stratum, grid=(0.01,),
                                   test=peptides.where("Label = 1"))
    assert given.report.first().auc == 0.5 and given.report.first().recall > 0.8
