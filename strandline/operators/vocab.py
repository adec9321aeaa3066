"""Category dictionaries: text to dense index, with reserved entries at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.plans.running import HOT_ROWS, dense_position
from strandline.plans.sizing import left_lookup, lookup_side, settle

UNKNOWN = "<UNK>"
NULL_CATEGORY = "NULL"
RESERVED = [UNKNOWN, NULL_CATEGORY]


def _with_reserved(numbered: DataFrame) -> DataFrame:
    words = F.posexplode(F.array(*map(F.lit, RESERVED))).alias("__at", "value")
    reserved = numbered.agg(F.count(F.lit(1)).alias("__size")).select("__size", words).select(
        "value", (F.col("__size") + F.col("__at")).cast("int").alias("idx"))
    return numbered.where(~F.col("value").isin(RESERVED)).unionByName(reserved)


def static_vocab(spark: SparkSession, values: list[str]) -> DataFrame:
    """Dictionary of a given list, sorted as text."""
    rows = [(v, i) for i, v in enumerate(sorted(values))]
    return _with_reserved(spark.createDataFrame(rows, "value string, idx int"))


def build_vocab(df: DataFrame, category: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Dictionary of the distinct values of a column: ``value``, ``idx``."""
    distinct = settle(df.select(F.col(category).cast("string").alias("value"))
                      .where(F.col("value").isNotNull()).distinct())
    numbered = dense_position(
        distinct.withColumn("__all", F.lit(0)), ["__all"], [F.col("value")], "idx", hot_rows)
    return _with_reserved(numbered.select("value", F.col("idx").cast("int").alias("idx")))


def reserved_index(vocab: DataFrame, word: str) -> Column:
    """Index of a reserved word as a scalar subquery; 0 when the dictionary lacks it."""
    return F.coalesce(vocab.where(F.col("value") == word).agg(F.max("idx")).scalar(), F.lit(0))


def category_index(
    df: DataFrame, category: str, vocab: DataFrame, name: str = "chain_index"
) -> DataFrame:
    """Add the dictionary index of a category; unknown and null values get ``<UNK>``."""
    words = lookup_side(vocab.select(F.col("value").alias(category), F.col("idx").alias(name)))
    unknown = reserved_index(words.toDF("value", "idx"), UNKNOWN)
    return left_lookup(df, words, [category]).withColumn(
        name, F.coalesce(F.col(name), unknown))
