"""Validate, clean and route sequence records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandline.functions.text import strip, tidy_category

# Accepted chain categories; the first stands for "no chain".
CHAINS = ["C0", "C6", "C8", "C10", "C12", "C14", "C16", "C18"]
NO_CHAIN = "C0"
NULL_CATEGORY = "NULL"


def inspect_records(
    df: DataFrame,
    sequence: str = "Sequence",
    category: str = "Fatty_acid_chain",
    allowed: list[str] = CHAINS,
    no_category: str = NO_CHAIN,
) -> DataFrame:
    """Add ``clean_sequence``, ``input_category``, ``routed_category`` and ``reason``.

    ``reason`` is null for a good row. The step is narrow: both outputs below are one
    filter away, and every input column is carried along.
    """
    cleaned = df.withColumns({
        "clean_sequence": strip(F.col(sequence).cast("string")),
        "input_category": tidy_category(F.col(category)),
    })
    known = F.col("input_category").isin(allowed)
    return cleaned.withColumns({
        "routed_category": F.when(F.col("input_category") == no_category, NULL_CATEGORY)
        .otherwise(F.col("input_category")),
        "reason": F.when(F.col("clean_sequence").isNull(), "null sequence")
        .when(F.col("input_category").isNull(), "null category")
        .when(~known, "invalid category"),
    })


def clean_route(df: DataFrame, **names) -> DataFrame:
    """Accepted rows: all input columns plus the cleaned and routed ones."""
    return inspect_records(df, **names).where(F.col("reason").isNull()).drop("reason")


def clean_rejects(df: DataFrame, **names) -> DataFrame:
    """Rejected rows: all input columns plus ``reason``."""
    return inspect_records(df, **names).where(F.col("reason").isNotNull()).select(
        *df.columns, "reason")
