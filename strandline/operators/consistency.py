"""Consistency loss between two vectors of a row, and the total loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.losses import flagged_mean
from strandline.functions.vectors import mean_squared_difference


def paired_consistency(
    df: DataFrame, first: Column, second: Column, flag: Column, classification: Column,
    by: list[str] = [], weight: float = 3.0,
) -> DataFrame:
    """Per group: mean classification loss, flagged consistency loss and their sum."""
    rows = df.withColumns({
        "__mse": mean_squared_difference(first, second), "__flag": flag.cast("double"),
        "__loss": classification})
    return rows.groupBy(*by).agg(
        F.avg("__loss").alias("classification"),
        flagged_mean(F.col("__mse"), F.col("__flag"), weight).alias("consistency"),
    ).withColumn("total", F.col("classification") + F.col("consistency"))
