"""No record is lost or predicted without a score; no input is cut short in silence."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import losses, vectors
from strandline.functions.text import residue_counts
from strandline.operators import metrics, pooling, score
from strandline.plans import scoring, training
from strandline.sources import tables
from strandline.sources.models import MODEL_SCHEMA, model_rows, save_fold

NAN = float("nan")


def models(spark, folds=(0, 7)):
    return spark.createDataFrame([row for f in folds for row in model_rows(f, {
        "head.weight": np.array([[0.0, 0.0], [1.0, 1.0 + f]]), "head.bias": np.zeros(2)})], MODEL_SCHEMA)


RECORDS = [("AC", "C6", [1.0, 1.0]), ("AC", "C6", None), ("AC", "C6", [NAN, 1.0]), (None, "C6", [1.0, 1.0]), ("AC", "X", [1.0, 1.0])]


def test_rejects(spark, tmp_path):
    rows = spark.createDataFrame(RECORDS, "Sequence string, Fatty_acid_chain string, v array<double>")
    good = scoring.score_records(rows, [F.col("v")], models(spark)).collect()
    assert [(r.Prediction, r.v) for r in good] == [(1, [1.0, 1.0])]
    bad = scoring.score_rejects(rows, [F.col("v")], models(spark)).collect()
    assert sorted(r.reason for r in bad) == sorted(["no features", "no score", "null sequence", "invalid category"])
    save_fold(models(spark), f"{tmp_path}/models")
    rows.write.parquet(f"{tmp_path}/in.parquet")
    scoring.score_file(spark, f"{tmp_path}/models", f"{tmp_path}/in.parquet", ["v"], f"{tmp_path}/out.csv",
                       rejects_path=f"{tmp_path}/rejects.csv")
    assert spark.read.csv(f"{tmp_path}/rejects.csv", header=True).count() == 4


def test_rules_without_a_score(spark):
    rows = spark.createDataFrame([(0.5,), (None,), (NAN,)], "p double")
    got = rows.select(losses.threshold_rule(F.col("p")), losses.argmax_rule(F.lit(0.0), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(1, 1), (None, None), (None, None)]


def test_fold_ids_are_kept(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "k int, v array<double>")
    got = score.fold_scores(rows, [F.col("v")], models(spark)).collect()
    assert [(r.k, r.fold_number) for r in got] == [(1, 0), (1, 7)]


def test_vectors_cut_without_loss(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in rows.select(vectors.in_tokens(F.col("v"), 2)).collect()] == [[[1.0, 2.0], [3.0, 4.0]], None, []]
    for size in (2, 11):
        with pytest.raises(Exception, match="can't be cut"):
            spark.createDataFrame([([1.0] * size,)], "v array<double>").select(vectors.in_tokens(F.col("v"), 4)).collect()


def test_masked_groups(spark):
    rows = spark.createDataFrame([(1, [2.0, 0.0], 0), (1, [4.0, 2.0], 0), (2, [1.0, 1.0], 1), (2, [9.0, 9.0], 0), (2, None, 1)],
                                 "g int, v array<double>, m int")
    pooled = pooling.attention_pool(rows, ["g"], "v", np.array([0.1, 0.2]), mask="m")
    got = {(r.g, r.pos): r.pooled for r in pooled.collect()}
    assert got == pytest.approx({(1, 0): 3.0, (1, 1): 1.0, (2, 0): 1.0, (2, 1): 1.0})
    plan = pooled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_skipped_labels(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.1), (None, 1, 0.5), (7, 0, 0.4), (1, None, 0.2)], "y int, p int, s double")
    assert metrics.metrics_by_group(rows, F.col("y"), F.col("p"), count_skipped=True).first().skipped == 3
    assert metrics.metric_bundle(rows, F.col("y"), F.col("s"), F.col("p"), count_skipped=True).first().skipped == 3
    assert metrics.metric_bundle(rows.limit(0), F.col("y"), F.col("s"), F.col("p"), count_skipped=True).first().skipped == 0


def test_peptides_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Label,Fatty_acid_chain,id,Length,Sequence,more\n1,C6,x,3,"A""C",9\n')
    assert tuple(tables.read_peptides(spark, f"{tmp_path}/a.csv").first()) == ("x", 'A"C', "C6", 1, 3)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write("Sequence,Label,Length\nACD,0,3\n")
    assert tuple(tables.read_peptides(spark, f"{tmp_path}/b.csv.gz").first()) == (None, "ACD", None, 0, 3)
    assert tables.read_table(spark, f"{tmp_path}/b.csv.gz").columns == ["Sequence", "Label", "Length"]
    (tmp_path / "c.csv").write_text("Sequence,Length\nACD,3\n")
    with pytest.raises(ValueError, match="Label"):
        tables.read_peptides(spark, f"{tmp_path}/c.csv")
    assert tables.read_table(spark, f"{tmp_path}/a.csv", format="csv").count() == 1
    with pytest.raises(ValueError):
        tables.format_of("folder", "xlsx")


def test_residue_counts(spark):
    rows = spark.createDataFrame([("abca é",), (None,), ("",), ("zzz",)], "t string")
    assert [r[0] for r in rows.select(residue_counts(F.col("t"), "abz")).collect()] == [
        [2.0, 1.0, 0.0], None, [0.0, 0.0, 0.0], [0.0, 0.0, 3.0]]


def test_training_takes_the_best_of_the_grid(spark):
    history = spark.createDataFrame([(0, e, "mcc", v) for e, v in enumerate([0.1, 0.0, -0.1, 0.4, 0.4, NAN])]
                                    + [(1, 0, "mcc", -1.0)], "fold int, epoch int, tag string, value double")
    got = {r.fold: (r.best_epoch, r.best_value) for r in training._best(history).collect()}
    assert got == {0: (3, 0.4), 1: (None, None)}


def test_training_reports_its_fits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "C6" if i % 2 else "C8", int(x[0] > 0), x.tolist()) for i, x in enumerate(rng.normal(size=(80, 3)))]
    df = spark.createDataFrame(rows, "id long, c string, y int, v array<double>").withColumn("i", (F.col("c") == "C6").cast("int"))
    run = training.train_kfold(df, "id", F.col("v"), "c", "i", 2, "y", k=2, grid=(0.01,), learner=training.logistic(training.Fit(max_iter=7)))
    tags = {r.tag for r in run.history.collect()}
    assert {"mcc", "train_mcc", "iterations", "train_loss"} <= tags
    assert all(r.value <= 7 for r in run.history.where("tag = 'iterations'").collect())
    best = run.history.where("tag = 'mcc'").agg(F.avg("value")).first()[0]
    assert run.summary.first().mean_best == pytest.approx(best) and run.summary.first().folds == 2
