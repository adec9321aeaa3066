"""Attention pooling of token tables, and small vector tables derived from data."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.hashing import digest, unit
from strandline.functions.vectors import dot

MASKED = 1e-300


def vector_means(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector per group, in long form ``by, pos, mean``.

    One JVM buffer per group is combined map-side, so at most one row per group leaves a task
    however large the group is. Rows without a vector don't count.
    """
    return _weighted_means(df, by, F.col(vector), F.lit(1.0), "mean")


def vector_sums(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Sum vector and number of rows per group, in long form ``by, pos, sum, count``.

    One JVM buffer per group, as in ``vector_means``. Rows without a vector, or with a null in it, don't count.
    """
    x = F.col(vector)
    rows = df.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull())).select(
        *by, array_to_vector(x.cast("array<double>")).alias("__x"))
    sums = rows.groupBy(*by).agg(vector_to_array(Summarizer.sum(F.col("__x"))).alias("__sum"), F.count(F.lit(1)).alias("count"))
    return sums.select(*by, "count", F.posexplode("__sum").alias("pos", "sum"))


def _weighted_means(df: DataFrame, by: list[str], vector: Column, weight: Column, name: str) -> DataFrame:
    """Weighted mean vector per group in long form; only one row per group is ever exploded."""
    rows = df.where(vector.isNotNull()).select(
        *by, array_to_vector(vector.cast("array<double>")).alias("__x"), weight.alias("__w"))
    means = rows.groupBy(*by).agg(vector_to_array(
        Summarizer.mean(F.col("__x"), F.col("__w"))).alias("__mean"))
    return means.select(*by, F.posexplode("__mean").alias("pos", name))


def gather_vectors(long: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Long form ``by, pos, value`` back to one array per group (one row per position)."""
    return long.groupBy(*by).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", value))), lambda p: p[value]).alias(name))


def attention_score(vector: Column, weights: np.ndarray, bias: float = 0.0) -> Column:
    """``tanh(w.x + b)``."""
    return F.tanh(dot(vector, weights, bias))


def attention_pool(
    tokens: DataFrame, by: list[str], vector: str, weights: np.ndarray, bias: float = 0.0,
    mask: str | None = None,
) -> DataFrame:
    """Softmax-weighted sum of the token vectors of each group, as ``by, pos, pooled``.

    The tokens come one per row. Scores lie in [-1, 1], so ``sum(e x) / sum(e)`` is safe as
    it stands: one aggregate with map-side combine, no window and no whole group in a task.
    Tokens with mask 0 (or null) have a weight that vanishes beside any other; a group of such tokens
    alone gets their plain mean.
    """
    weight = F.exp(attention_score(F.col(vector), weights, bias))
    if mask is not None:
        weight = F.when(F.col(mask) != 0, weight).otherwise(F.lit(MASKED))
    return _weighted_means(tokens, by, F.col(vector), weight, "pooled")


def noise_augment(
    df: DataFrame, key: str, vector: str, level: float = 0.1, seed: int = 42,
    name: str | None = None,
) -> DataFrame:
    """Add Gaussian noise of standard deviation ``level`` to every element.

    One md5 of (seed, key, pair number) gives two uniforms and, by Box-Muller, the noise of
    two neighbouring elements; the result does not depend on partitioning or retries.
    """
    pairs = F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 2).cast("int"))
    hashed = F.transform(pairs, lambda p: digest(F.lit(seed), F.col(key), p))
    radius_angle = F.transform(hashed, lambda h: F.struct(
        F.sqrt(-2.0 * F.log(1.0 - unit(h))).alias("r"),
        (F.lit(2 * np.pi) * unit(h, 1)).alias("a")))
    noise = F.flatten(F.transform(radius_angle, lambda n: F.array(
        n["r"] * F.cos(n["a"]), n["r"] * F.sin(n["a"]))))
    return df.withColumn(name or vector, F.zip_with(
        F.col(vector), F.slice(noise, 1, F.size(vector)),
        lambda x, z: x.cast("double") + level * z))
