"""Ensemble scoring: mean probability of the fold heads, rounding and decision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.losses import argmax_rule, softmax_positive, threshold_rule
from strandline.operators.blocks import with_logits
from strandline.operators.heads import head_logits, linear_head
from strandline.sources.models import MAX_MODEL_NUMBERS, list_folds, model_numbers


def fold_probabilities(logits: Column) -> Column:
    """Positive probability of every fold from an array of logit pairs."""
    firsts = F.sequence(F.lit(1), F.size(logits) - 1, F.lit(2))
    return F.transform(firsts, lambda i: softmax_positive(
        F.element_at(logits, i), F.element_at(logits, i + 1)))


def array_mean(values: Column) -> Column:
    """Mean of an array."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def ensemble_score(
    df: DataFrame, inputs: list[Column], models: DataFrame,
    forward: Callable[..., np.ndarray] = linear_head, threshold: float = 0.5,
    key: str | None = None, max_numbers: int = MAX_MODEL_NUMBERS,
) -> DataFrame:
    """Add ``Probability`` (mean over folds, 4 digits) and ``Prediction``.

    All folds score a row in one pass; no shuffle, no join. The unrounded mean decides.
    Linear heads of more than ``max_numbers`` parameters in all are not broadcast if a unique ``key`` is given: their blocks are joined to
    blocks of the rows' vectors.
    """
    if key is not None and forward is linear_head and model_numbers(models) > max_numbers:
        scored = with_logits(df, key, inputs[0], models, "__logits")
    else:
        scored = df.withColumn("__logits", head_logits(inputs, models, forward))
    return (
        scored
        .withColumn("__mean", array_mean(fold_probabilities(F.col("__logits"))))
        .withColumn("Probability", F.round("__mean", 4))
        .withColumn("Prediction", threshold_rule(F.col("__mean"), threshold))
        .drop("__logits", "__mean")
    )


def fold_scores(
    df: DataFrame, inputs: list[Column], models: DataFrame,
    forward: Callable[..., np.ndarray] = linear_head,
) -> DataFrame:
    """One row per scored row and fold: all input columns, ``fold_number``, ``probability``.

    Fold numbers are those of the model table, which may have holes.
    """
    folds = F.array(*[F.lit(f) for f in list_folds(models)])
    scored = df.withColumn("__logits", head_logits(inputs, models, forward))
    pairs = F.zip_with(folds, fold_probabilities(F.col("__logits")), lambda f, p: F.struct(
        f.alias("fold_number"), p.alias("probability")))
    return scored.where(F.col("__logits").isNotNull()).select(*df.columns, F.inline(pairs))


def predict_rules(df: DataFrame, l0: Column, l1: Column, threshold: float = 0.5) -> DataFrame:
    """Add the probability and both decision rules, which differ at exactly the threshold."""
    probability = softmax_positive(l0, l1)
    return df.withColumns({
        "probability": probability,
        "by_threshold": threshold_rule(probability, threshold),
        "by_argmax": argmax_rule(l0, l1),
    })
