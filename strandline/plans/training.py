"""Training pipelines: weighted stratified k-fold and hold-out, with MLlib models.

The network trainer of a deep model is out of scope; a logistic model on the feature vector
and the category takes its place. Folds, weights, metric history, choice of the best
checkpoint and the reports are the point here. Other learners of linear heads can be passed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.losses import argmax_rule, softmax_positive
from strandline.functions.text import stratum_key
from strandline.operators.heads import linear_head, row_head
from strandline.operators.history import cv_summary
from strandline.operators.metrics import COUNT_METRICS, CURVE_METRICS, metric_bundle
from strandline.operators.split import stratified_kfold, stratified_split, train_part
from strandline.operators.union import sample_group
from strandline.plans.sizing import compact, left_lookup, lookup_side, settle
from strandline.sources.models import MODEL_SCHEMA, model_rows, publish_best
from strandline.sources.tables import append_history, write_table

GRID = (0.01, 0.1)  # regularisation strengths, tried in this order


@dataclass
class Fit:
    """How MLlib fits: its own defaults, and how many fits run at once."""

    max_iter: int = 100
    tol: float = 1e-6
    parallel: int = 2


@dataclass
class Training:
    """What a training run leaves: the metric history, the best models, the reports.

    ``summary`` is the mean over folds of the best validation metric (k-fold only); ``scores`` has that metric by fold.
    """

    history: DataFrame
    models: DataFrame
    report: DataFrame
    summary: DataFrame | None = None
    scores: dict[int, float] = field(default_factory=dict)


def save_training(run: Training, folder: str) -> list[int]:
    """Publish the folds' models that beat what the folder holds, log the metric history once, write the report as CSV.

    Returns the published folds; models of a worse run are left as they are.
    """
    better = publish_best(run.models, run.scores, f"{folder}/models")
    append_history(run.history, f"{folder}/history")
    write_table(run.report, f"{folder}/report.csv")
    return better


def with_category(features: Column, index: Column, categories: int) -> Column:
    """The features followed by the one-hot category index."""
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(categories - 1)),
                          lambda i: (i == index).cast("double"))
    return F.concat(features.cast("array<double>"), one_hot)


def fold_weights(df: DataFrame, group: str, fold: str, k: int, name: str) -> DataFrame:
    """Add an array with, per fold, 1 / (rows of the group in that fold's training part).

    Rows without a fold belong to every training part. One aggregate serves all folds.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__all"), *[
        F.sum((F.col(fold) == f).cast("long")).alias(f"__f{f}") for f in range(k)])
    weights = [F.lit(1.0) / F.nullif(F.col("__all") - F.coalesce(F.col(f"__f{f}"), F.lit(0)),
                                     F.lit(0)) for f in range(k)]
    table = sizes.select(group, F.array(*weights).alias(name))
    return left_lookup(df, lookup_side(table), [group])


# A learner fits candidates: (part, strength) pairs and a function that gives a part's rows with
# features (vector), label and weight. It returns each one's linear head and what to log of the fit.
Learner = Callable[[list[tuple], Callable[[int], DataFrame]], dict[tuple, tuple[dict, dict]]]


def logistic(how: Fit = Fit()) -> Learner:
    """MLlib's logistic regression; strengths are those of its regularisation."""
    def learn(jobs, rows_of):
        def fit(job):
            part, strength = job
            model = LogisticRegression(
                maxIter=how.max_iter, tol=how.tol, regParam=strength, labelCol="label",
                featuresCol="features", weightCol="weight").fit(rows_of(part))
            return job, (_parameters(model), {"iterations": model.summary.totalIterations,
                                              "train_loss": list(model.summary.objectiveHistory)[-1]})

        spark = rows_of(jobs[0][0]).sparkSession
        with ThreadPool(how.parallel) as pool:
            return dict(pool.map(inheritable_thread_target(spark)(fit), jobs))

    return learn


def centroids() -> Learner:
    """Weighted nearest centroids in closed form; a strength moves both towards the mean of all.

    One aggregate per part with a JVM buffer per class; all strengths follow from it. A class without rows
    stands at the mean of all.
    """
    def learn(jobs, rows_of):
        out = {}
        for part in sorted({part for part, _ in jobs}):
            found = {int(r.label): (np.array(r.mean), r.weight) for r in rows_of(part).where("weight > 0").groupBy(
                "label").agg(vector_to_array(Summarizer.mean(F.col("features"), F.col("weight"))).alias("mean"),
                             F.sum("weight").alias("weight")).collect()}
            if not found:
                raise ValueError("a training part has no rows")
            centre = sum(m * w for m, w in found.values()) / sum(w for _, w in found.values())
            means = [found.get(c, (centre, 0.0))[0] for c in (0, 1)]
            for strength in (s for p, s in jobs if p == part):
                m0, m1 = ((1 - strength) * m + strength * centre for m in means)
                out[part, strength] = {"head.weight": np.stack([np.zeros_like(m0), m1 - m0]),
                                       "head.bias": np.array([0.0, (m0 @ m0 - m1 @ m1) / 2])}, {}
        return out

    return learn


def _fit_all(parts: range, grid: tuple, data_of, weight_of, learner: Learner) -> tuple[dict, dict]:
    """Heads and logs of every (part, candidate)."""
    def rows_of(part):
        return data_of(part).select(array_to_vector("features").alias("features"), "label",
                                    weight_of(part).alias("weight"))

    found = learner([(p, strength) for p in parts for strength in grid], rows_of)
    named = {(p, c): found[p, strength] for p in parts for c, strength in enumerate(grid)}
    return {j: head for j, (head, _) in named.items()}, {j: log for j, (_, log) in named.items()}


def _scored(rows: DataFrame, heads: dict[tuple, dict], grid: tuple) -> DataFrame:
    """Each row scored by every candidate of every fold, in one pass of all heads over it.

    Only scores are repeated, never features: a row is ``val`` for its own fold's candidates and ``train`` for all others.
    """
    order = sorted(heads)
    head = {f"head.{name}": np.concatenate([heads[j][f"head.{name}"] for j in order])
            for name in ("weight", "bias")}
    scored = rows.select("fold", F.col("label").cast("int").alias("label"),
                         row_head(head, linear_head, [F.col("features")]).alias("__logits"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(len(order) - 1)), lambda i: F.struct(
        F.element_at("__logits", 2 * i + 1).alias("l0"), F.element_at("__logits", 2 * i + 2).alias("l1")))
    number = F.floor(F.col("at") / len(grid)).cast("int")
    return scored.select("fold", "label", F.posexplode(pairs).alias("at", "l")).select(
        F.when(F.col("fold") == number, "val").otherwise("train").alias("part"), number.alias("fold"),
        (F.col("at") % len(grid)).alias("candidate"), "label",
        softmax_positive(F.col("l.l0"), F.col("l.l1")).alias("score"), argmax_rule(F.col("l.l0"), F.col("l.l1")).alias("prediction"))


def _history(metrics: DataFrame, trained: DataFrame, fits: dict, run: str) -> DataFrame:
    """Validation metrics, the same on the training part (``train_...``), and how each fit went."""
    names = [*COUNT_METRICS, *CURVE_METRICS]

    def tags(table, prefix):
        return table.select(
            F.lit(run).alias("run"), F.col("fold").cast("int").alias("fold"), F.col("candidate").alias("epoch"),
            F.explode(F.create_map(*[x for n in names for x in (F.lit(prefix + n), F.col(n))])).alias("tag", "value"))

    went = [(run, int(f), int(c), tag, float(value))
            for (f, c), log in fits.items() for tag, value in log.items()]
    return tags(metrics, "").unionByName(tags(trained, "train_")).unionByName(
        metrics.sparkSession.createDataFrame(went, "run string, fold int, epoch int, tag string, value double"))


def _best(history: DataFrame) -> DataFrame:
    """The candidate of the largest MCC of each fold over the whole grid; the first one wins a tie.

    Candidates are no epochs, so none is left out after poor ones.
    """
    counts = (F.col("value") > -1) & ~F.isnan("value")
    return history.where("tag = 'mcc'").groupBy("fold").agg(
        F.max_by("epoch", F.when(counts, F.struct("value", -F.col("epoch")))).alias("best_epoch"),
        F.max(F.when(counts, F.col("value"))).alias("best_value"))


def _metrics(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics of every fold and candidate on the validation and on the training part."""
    both = settle(metric_bundle(scored, F.col("label"), F.col("score"), F.col("prediction"), ["part", "fold", "candidate"]))
    return tuple(both.where(F.col("part") == part).drop("part") for part in ("val", "train"))


def _parameters(model: LogisticRegressionModel) -> dict[str, np.ndarray]:
    row = model.coefficients.toArray()
    return {"head.weight": np.stack([np.zeros_like(row), row]),
            "head.bias": np.array([0.0, model.intercept])}


def train_kfold(
    df: DataFrame, key: str, features: Column, category: str, index: str, categories: int,
    label: str, plain: DataFrame | None = None, k: int = 5, grid: tuple = GRID, seed: int = 42,
    run: str = "kfold", learner: Learner = logistic(),
) -> Training:
    """Per fold: fit on the other folds (and ``plain``) with balancing weights, keep the best.

    ``plain`` rows have no fold and train in all. ``report`` has one row per fold: the best
    candidate, row counts and its validation metrics; the model table holds one linear head
    per fold, as ``ensemble_score`` reads it.
    """
    folded = stratified_kfold(
        df, stratum_key(F.col(category), F.col(label)), key, k, seed=seed, unique=True
    ).withColumn("is_lipo", F.lit(1.0))
    if plain is not None:
        folded = folded.unionByName(
            plain.withColumn("is_lipo", F.lit(0.0)), allowMissingColumns=True)
    grouped = folded.withColumn(
        "sample_group", sample_group(F.col(category), F.col(label), F.col("is_lipo")))
    data = fold_weights(compact(settle(grouped.select(
        with_category(features, F.col(index), categories).alias("features"),
        F.col(label).cast("double").alias("label"), "fold", "sample_group",
    ))), "sample_group", "fold", k, "weights")

    data = settle(data)
    fitted, fits = _fit_all(range(k), grid, lambda f: train_part(data, f),
                            lambda f: F.col("weights")[f], learner)
    metrics, trained = _metrics(_scored(data, fitted, grid))
    history = _history(metrics, trained, fits, run)
    best = settle(_best(history))
    found = best.collect()
    chosen = {r.fold: r.best_epoch for r in found}
    models = data.sparkSession.createDataFrame([
        row for f, c in chosen.items() if c is not None
        for row in model_rows(f, fitted[f, c])], MODEL_SCHEMA)
    sizes = data.groupBy().agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum((F.col("fold") == f).cast("long")).alias(f"f{f}") for f in range(k)])
    counts = sizes.select(F.col("rows"), F.posexplode(
        F.array(*[f"f{f}" for f in range(k)])).alias("fold", "val_rows")).select(
        "fold", (F.col("rows") - F.coalesce(F.col("val_rows"), F.lit(0))).alias("train_rows"),
        "val_rows")
    report = (
        best.select("fold", F.col("best_epoch").alias("candidate"))
        .join(metrics, ["fold", "candidate"], "left").join(counts, "fold").orderBy("fold"))
    summary = cv_summary(best.withColumn("run", F.lit(run)), ["run"])
    return Training(history, models, report, summary, {r.fold: r.best_value for r in found})


def train_holdout(
    df: DataFrame, key: str, features: Column, label: str, stratum: Column,
    grid: tuple = GRID, seed: int = 42, run: str = "holdout", learner: Learner = logistic(),
    test: DataFrame | None = None,
) -> Training:
    """70/15/15 split, fit on train, choose by validation MCC, report on test in one row.

    A separate ``test`` table with the same columns takes the place of the test part.
    """
    vector = features.cast("array<double>").alias("features")
    target = F.col(label).cast("double").alias("label")
    data = compact(settle(
        stratified_split(df, stratum, key, seed=seed, unique=True).select(vector, target, "split")))
    fitted, fits = _fit_all(range(1), grid, lambda _: data.where("split = 'train'"),
                            lambda _: F.lit(1.0), learner)
    fold = F.when(F.col("split") == "val", 0)
    metrics, trained = _metrics(_scored(data.where("split <> 'test'").withColumn("fold", fold), fitted, grid))
    history = _history(metrics, trained, fits, run)
    best = _best(history).first()
    if best is None or best.best_epoch is None:
        raise ValueError("no candidate exceeds an MCC of -1 on the validation part")
    chosen = fitted[0, best.best_epoch]
    models = data.sparkSession.createDataFrame(model_rows(0, chosen), MODEL_SCHEMA)
    held = data.where("split = 'test'") if test is None else test.select(vector, target)
    report = metric_bundle(
        _scored(held.withColumn("fold", F.lit(0)), {(0, 0): chosen}, grid[:1]), F.col("label"), F.col("score"), F.col("prediction"))
    return Training(history, models, report, scores={0: best.best_value})
