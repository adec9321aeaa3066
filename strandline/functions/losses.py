"""Decision rules and losses as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def softmax_positive(l0: Column, l1: Column) -> Column:
    """Softmax over two logits, probability of the second."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(l0 - l1))


def is_number(value: Column) -> Column:
    """Whether a value is neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def threshold_rule(probability: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold on (so 1 at exactly 0.5); null without a probability."""
    return F.when(is_number(probability), F.when(probability >= threshold, 1).otherwise(0))


def argmax_rule(l0: Column, l1: Column) -> Column:
    """Index of the larger logit; the first wins a tie (so 0 at probability 0.5); null without both."""
    return F.when(is_number(l0) & is_number(l1), F.when(l1 > l0, 1).otherwise(0))


def argmax(values: Column) -> Column:
    """Index of the first largest element of an array."""
    return F.array_position(values, F.array_max(values)) - 1


def _softplus(x: Column) -> Column:
    """``ln(1 + e^x)`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def binary_cross_entropy(logit: Column, label: Column) -> Column:
    """Cross-entropy of one logit against a 0/1 label."""
    return _softplus(logit) - logit * label


def focal_loss(logit: Column, label: Column, alpha: float = 0.75, gamma: float = 2.0) -> Column:
    """Cross-entropy scaled by ``alpha (1 - p)^gamma`` with p the probability of the label."""
    loss = binary_cross_entropy(logit, label)
    return alpha * F.pow(-F.expm1(-loss), F.lit(gamma)) * loss


def cross_entropy(l0: Column, l1: Column, label: Column) -> Column:
    """Cross-entropy of two logits: log-sum-exp minus the logit of the label.

    Null where a logit or the label is null, or the label is neither 0 nor 1, so that a mean leaves such rows out.
    """
    return F.greatest(l0, l1) + F.log1p(F.exp(-F.abs(l0 - l1))) - F.when(
        label == 1, l1).when(label == 0, l0)


def flagged_mean(value: Column, flag: Column, weight: float = 3.0) -> Column:
    """Aggregate: weighted mean of the flagged values; 0 when no row is flagged."""
    mean = F.sum(value * flag) / (F.sum(flag) + F.lit(1e-8))
    return F.coalesce(F.when(F.sum(flag) > 0, mean * weight), F.lit(0.0))
