"""Heads in blocks against heads in memory, curves cut into ranges, positions of narrow rows, unique keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import losses
from strandline.operators import balance, blocks, metrics, score, split
from strandline.plans import scoring
from strandline.sources.models import MODEL_SCHEMA, model_rows

WIDTH = 50


@pytest.fixture(scope="module")
def heads(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([row for fold in (4, 0, 7) for row in model_rows(fold, {
        "head.weight": rng.normal(size=(2, WIDTH)), "head.bias": rng.normal(size=2)})], MODEL_SCHEMA)


def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"s{i}", rng.normal(size=WIDTH).tolist()) for i in range(40)]
    rows += [(100, "none", None), (101, "hole", [None] + [1.0] * (WIDTH - 1)), (102, "short", [1.0, 2.0])]
    return spark.createDataFrame(rows, "id long, text string, x array<double>").repartition(3)


@pytest.mark.parametrize("block, task_rows", [(7, 9), (50, 1000), (64, 5), (1, 100)])
def test_blocks_give_the_scores_of_whole_heads(spark, heads, block, task_rows):
    rows = vectors(spark)
    whole = {r.id: list(r.l) for r in rows.where("id < 100").select("id", score.head_logits(
        [F.col("x")], heads, score.linear_head).alias("l")).collect()}
    got = {r.id: list(r.logits) for r in blocks.blocked_logits(rows, "id", F.col("x"), heads, block, task_rows).collect()}
    assert got.keys() == whole.keys()
    assert all(np.allclose(got[i], whole[i], rtol=1e-12, atol=1e-12) for i in got)


def test_heads_over_the_limit_are_scored_in_blocks(spark, heads):
    rows = vectors(spark)
    inside = score.ensemble_score(rows.where("id < 100"), [F.col("x")], heads)
    beyond = score.ensemble_score(rows, [F.col("x")], heads, key="id", max_numbers=10)
    expected = {r.id: (r.Probability, r.Prediction) for r in inside.collect()}
    got = {r.id: (r.Probability, r.Prediction) for r in beyond.collect()}
    assert got == expected | {i: (None, None) for i in (100, 101, 102)}


def test_a_fold_that_is_too_large_to_send(spark):
    big = spark.sql("select 0 fold, 'head.weight' name, array(2, 3145728) shape, array_repeat(0d, 6291456) `values`")
    with pytest.raises(ValueError, match="scored in blocks if a key is given"):
        score.ensemble_score(vectors(spark), [F.col("x")], big)


def test_scored_once_for_both_outputs(spark, shared_checkpoints):
    rows = spark.createDataFrame([(1, "AK", "C6", [1.0]), (2, "AK", "C7", [1.0]), (3, "AK", "C8", None), (4, None, "C6", [2.0])],
                                 "id int, Sequence string, Fatty_acid_chain string, x array<double>")
    one = spark.createDataFrame(model_rows(0, {"head.weight": np.array([[0.0], [1.0]]), "head.bias": np.zeros(2)}), MODEL_SCHEMA)
    args = rows, [F.col("x")], one
    good, bad = scoring.score_both(*args)
    assert sorted(map(str, good.collect())) == sorted(map(str, scoring.score_records(*args).collect()))
    assert sorted(map(str, bad.collect())) == sorted(map(str, scoring.score_rejects(*args).collect()))
    assert good.count() == 1 and bad.count() == 3
    assert all("PythonUDF" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (good, bad))


@pytest.fixture
def shared_checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))


@pytest.mark.parametrize("hot_rows", [10, 60, 1000])
def test_curves_in_ranges(spark, hot_rows):
    rng = random.Random(8)
    rows = [(g, rng.choice([0, 1, 1, None, 2]), rng.choice([rng.random(), round(rng.random(), 1), 0.5]))
            for g in ("a", "b", None) for _ in range(120)] + [("a", 1, None), ("b", 0, float("nan")), ("one", 1, .5)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    whole = metrics.metric_bundle(df, F.col("y"), F.col("s"), losses.threshold_rule(F.col("s")), ["g"])
    cut = metrics.metric_bundle(df, F.col("y"), F.col("s"), losses.threshold_rule(F.col("s")), ["g"], hot_rows=hot_rows)
    expected, got = ({r.g: tuple(r)[1:] for r in x.collect()} for x in (whole, cut))
    assert got.keys() == expected.keys()
    assert all(np.allclose(got[g], expected[g], rtol=1e-12) for g in got)


def test_positions_leave_other_columns_alone(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, f"e{i % 3}", rng.randint(0, 20), "wide" * 50) for i in range(300)],
                                 "id long, epoch string, ts long, text string").repartition(4)
    for hot_rows in (20, 10 ** 6):
        plain = metrics.number_batches(rows, "epoch", [F.col("ts"), F.col("id")], 7, hot_rows=hot_rows)
        keyed = metrics.number_batches(rows, "epoch", ["ts"], 7, hot_rows=hot_rows, key="id")
        assert keyed.columns == plain.columns
        assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, plain.collect()))
    for placed in (keyed, balance.shuffle_position(rows, "id")):
        plan = placed._jdf.queryExecution().optimizedPlan().toString()
        below = [line for line in plan[plan.index("Window"):].splitlines() if "LogicalRDD" not in line]
        assert not any("text#" in line for line in below) and "text#" in plan


def test_repeated_keys_are_counted(spark):
    rows = spark.createDataFrame([(i % 90, "s") for i in range(100)], "id int, s string")
    with pytest.raises(ValueError, match="10 rows repeat a key"):
        split.stratified_kfold(rows, F.col("s"), "id", unique=True)
    with pytest.raises(ValueError, match="10 rows repeat a key"):
        split.stratified_split(rows, F.col("s"), "id", unique=True)
    fine = rows.dropDuplicates(["id"])
    assert split.stratified_kfold(fine, F.col("s"), "id", unique=True).count() == 90


def test_labels_that_are_no_class(spark):
    rows = spark.createDataFrame([(0.0, 2.0, y) for y in (0, 1, None, 2)], "l0 double, l1 double, y int")
    got = [r.v for r in rows.select(losses.cross_entropy(F.col("l0"), F.col("l1"), F.col("y")).alias("v")).collect()]
    assert got[0] == pytest.approx(2.126928) and got[1] == pytest.approx(0.126928) and got[2:] == [None, None]


def test_centroid_heads_explode_no_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 3, i % 2, rng.normal(size=4).tolist()) for i in range(60)] + [(0, 1, None), (1, None, [1.0] * 4), (2, 1, [None] * 4)]
    df = spark.createDataFrame(rows, "fold int, y int, x array<double>")
    built = scoring.centroid_heads(df, "fold", "y", "x")
    got = {(r.fold, r.name): r["values"] for r in built.collect()}
    for fold in range(3):
        x, y = np.array([r[2] for r in rows[:60] if r[0] != fold]), np.array([r[1] for r in rows[:60] if r[0] != fold])
        m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
        assert np.allclose(got[fold, "head.weight"], [0] * 4 + (m1 - m0).tolist())
        assert np.allclose(got[fold, "head.bias"], [0, (m0 @ m0 - m1 @ m1) / 2])
