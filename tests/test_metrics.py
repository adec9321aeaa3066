"""Metrics, losses, metric history."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import losses
from strandline.operators import history, metrics
from strandline.operators.consistency import paired_consistency

SCORES = [.9, .8, .8, .7, .6, .6, .5, .3, .3, .1]
LABELS = [1, 0, 1, 1, 0, 0, 1, 0, 1, 0]


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return 0.5
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


def brute_ap(rows):
    total, area, before = sum(y for _, y in rows), 0.0, 0.0
    for cut in sorted({s for s, _ in rows}, reverse=True):
        taken = [y for s, y in rows if s >= cut]
        recall = sum(taken) / total if total else 0.0
        area += (recall - before) * sum(taken) / len(taken)
        before = recall
    return area


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, y int")


def bundle(df, by=[], **more):
    return metrics.metric_bundle(df, F.col("y"), F.col("score"),
                                 losses.threshold_rule(F.col("score")), by, **more)


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_auc_with_ties(spark, hot_rows):
    got = metrics.auc_ap(scored(spark, list(zip(SCORES, LABELS))), F.col("y"), F.col("score"),
                         hot_rows=hot_rows).first()
    assert got.auc == pytest.approx(0.68) and got.pr_auc == pytest.approx(0.70873016)


@pytest.mark.parametrize("hot_rows", [20, 1000])
def test_curves_by_group_against_brute_force(spark, hot_rows):
    draw = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", round(0.5 + draw.random() / 50, 4), int(draw.random() < .4))
            for i in range(900)]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    for r in bundle(df, ["g"], hot_rows=hot_rows).collect():
        mine = [(s, y) for g, s, y in rows if g == r.g]
        assert r.auc == pytest.approx(brute_auc(mine)) and r.pr_auc == pytest.approx(brute_ap(mine))


def test_bundle_by_hand(spark):
    got = bundle(scored(spark, list(zip(SCORES, LABELS)))).first()
    # at 0.5: tp 4, fp 3, fn 1, tn 2
    assert got.acc == pytest.approx(0.6) and got.recall == pytest.approx(0.8)
    assert got.precision == pytest.approx(4 / 7) and got.f1 == pytest.approx(8 / 12)
    assert got.mcc == pytest.approx((4 * 2 - 3 * 1) / math.sqrt(7 * 5 * 5 * 3))


def test_one_class_and_empty(spark):
    one = bundle(scored(spark, [(.9, 1), (.2, 1)])).first()
    assert one.auc == 0.5 and one.mcc == 0.0 and one.pr_auc == 1.0
    none = bundle(scored(spark, [])).collect()
    assert len(none) == 1 and none[0].asDict() == {
        "acc": 0, "mcc": 0, "f1": 0, "recall": 0, "precision": 0, "auc": 0.5, "pr_auc": 0}
    assert metrics.metrics_by_group(scored(spark, []), F.col("y"), F.lit(1)).first().acc == 0


def test_decision_rules_differ_at_the_threshold(spark):
    row = spark.range(1).select(
        losses.softmax_positive(F.lit(0.0), F.lit(0.0)).alias("p"),
        losses.threshold_rule(F.lit(0.5)).alias("t"),
        losses.argmax_rule(F.lit(0.0), F.lit(0.0)).alias("a"),
        losses.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("m")).first()
    assert tuple(row) == (0.5, 1, 0, 1)


@pytest.mark.parametrize("z, y", [(0.0, 1), (3.2, 0), (-40.0, 1), (800.0, 0), (-2.0, 0)])
def test_losses(spark, z, y):
    row = spark.range(1).select(
        losses.focal_loss(F.lit(z), F.lit(y), 0.7).alias("focal"),
        losses.cross_entropy(F.lit(0.0), F.lit(z), F.lit(y)).alias("ce")).first()
    bce = max(z, 0) - z * y + math.log1p(math.exp(-abs(z)))
    assert row.focal == pytest.approx(0.7 * (1 - math.exp(-bce)) ** 2 * bce, abs=1e-12)
    assert row.ce == pytest.approx(bce, abs=1e-12)


def test_focal_by_hand(spark):
    got = spark.range(1).select(losses.focal_loss(F.lit(0.0), F.lit(1), 0.7)).first()[0]
    assert got == pytest.approx(0.121301, abs=1e-6)


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_batches_and_epoch_loss(spark, hot_rows):
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((1, 1, 4))] + [(1, 0, 7.0)],
                                 "epoch int, i int, loss double")
    batched = metrics.number_batches(rows, "epoch", [F.col("i")], 2, hot_rows=hot_rows)
    got = {r.epoch: r for r in metrics.epoch_loss(batched, "epoch", "batch", F.col("loss")).collect()}
    assert (got[0].batch_mean, got[0].row_mean, got[0].batches) == (2.5, 2.0, 2)
    assert (got[1].batch_mean, got[1].row_mean) == (7.0, 7.0)


def test_paired_consistency(spark):
    rows = spark.createDataFrame([
        ([1.0, 2.0], [3.0, 5.0], 1, .5), ([0.0, 0.0], [10.0, 10.0], 0, 1.5)],
        "a array<double>, b array<double>, f int, l double")
    got = paired_consistency(rows, F.col("a"), F.col("b"), F.col("f"), F.col("l")).first()
    assert got.consistency == pytest.approx(19.5, abs=1e-6) and got.classification == 1.0
    assert got.total == pytest.approx(20.5, abs=1e-6)
    none = paired_consistency(rows, F.col("a"), F.col("b"), F.lit(0), F.col("l")).first()
    assert none.consistency == 0.0 and none.total == 1.0


def loop(values, patience):
    """The training loop the query stands for."""
    best, best_epoch, waited = -1.0, None, 0
    for epoch, v in enumerate(values):
        if v is not None and v > best:
            best, best_epoch, waited = v, epoch, 0
        else:
            waited += 1
            if waited >= patience:
                return best_epoch, epoch, epoch
    return best_epoch, None, len(values) - 1


CASES = [
    ([.2, .5, .5, .4, .3], 3), ([-1.0, -1.0], 8), ([-2.0, -1.5], 1), ([.1], 1), ([.3, .2, .9], 1),
    ([float("nan"), .1, float("nan"), .2], 3), ([.1, .2, .3], 8), ([-1.0, -1.0, -1.0, .5], 3)]


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_best_checkpoint_by_hand(spark, hot_rows):
    for patience in {p for _, p in CASES}:
        mine = [(i, v) for i, (v, p) in enumerate(CASES) if p == patience]
        rows = spark.createDataFrame(
            [(i, e, v) for i, values in mine for e, v in enumerate(values)],
            "run int, epoch int, value double")
        got = {r.run: r for r in history.best_checkpoint(
            rows, ["run"], patience=patience, hot_rows=hot_rows).collect()}
        for i, values in mine:
            best, stop, last = loop(values, patience)
            assert (got[i].best_epoch, got[i].stop_epoch, got[i].last_epoch) == (best, stop, last)
            assert got[i].best_value == (None if best is None else values[best])


@pytest.mark.parametrize("hot_rows", [25, 10_000])
def test_best_checkpoint_against_the_loop(spark, hot_rows):
    draw = random.Random(5)
    runs = {r: [draw.random() * (e ** .3 if r % 2 else 1) - 1.2 * (r % 3 == 0)
                for e in range(draw.randint(1, 400 if r == 0 else 60))] for r in range(30)}
    rows = spark.createDataFrame(
        [(r, e, v) for r, values in runs.items() for e, v in enumerate(values)],
        "run int, epoch int, value double").repartition(6)
    for patience in (2, 8):
        for r in history.best_checkpoint(rows, ["run"], patience=patience, hot_rows=hot_rows).collect():
            assert (r.best_epoch, r.stop_epoch, r.last_epoch) == loop(runs[r.run], patience)


def test_report_and_summary(spark):
    rows = spark.range(12).select(F.col("id").alias("epoch"))
    assert [r.epoch for r in history.history_report(rows).orderBy("epoch").collect()] == [0, 4, 9]
    best = spark.createDataFrame([("r", 0, .5), ("r", 1, None)], "run string, fold int, best_value double")
    got = history.cv_summary(best, ["run"]).first()
    assert (got.mean_best, got.folds) == (-0.25, 2)
