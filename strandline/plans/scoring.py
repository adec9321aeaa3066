"""The scoring pipeline: from raw records and fold models to predictions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from strandline.functions.losses import is_number
from strandline.operators.clean import CHAINS, NO_CHAIN, inspect_records
from strandline.operators.heads import linear_head
from strandline.operators.pooling import vector_sums
from strandline.operators.score import ensemble_score
from strandline.plans.sizing import shared_folder
from strandline.sources.models import read_models
from strandline.sources.tables import read_table, require_columns, write_table

NO_FEATURES = "no features"
NO_SCORE = "no score"
PREDICTED = "__predicted"


def score_records(
    records: DataFrame, inputs: list[Column], models: DataFrame,
    forward: Callable[..., np.ndarray] = linear_head,
    sequence: str = "Sequence", category: str = "Fatty_acid_chain",
    allowed: list[str] = CHAINS, no_category: str = NO_CHAIN, threshold: float = 0.5, key: str | None = None,
) -> DataFrame:
    """Check columns, drop rejects, score by the ensemble; input columns plus two new ones.

    Rows without a score (null or incomplete features, a result that is no number) are no predictions;
    ``score_rejects`` lists them with the other rejects.

    With a unique ``key``, linear heads too large to be sent to the tasks are scored block by block (see ``ensemble_score``).

    ``inputs`` are the feature columns the head takes and may use ``clean_sequence`` and
    ``routed_category``. Without aggregate or shuffle, so it also runs on a stream, and an
    empty input gives an empty output of the same schema.
    """
    scored = _scored(records, inputs, models, forward, sequence, category, allowed, no_category, threshold, key)
    return scored.where(F.col("reason").isNull()).select(*records.columns, "Probability", "Prediction")


def _scored(records, inputs, models, forward, sequence, category, allowed, no_category, threshold, key=None):
    """All records with ``Probability``, ``Prediction`` and the ``reason`` of those without."""
    require_columns(records, [sequence, category])
    inspected = inspect_records(records, sequence=sequence, category=category, allowed=allowed,
                                no_category=no_category)
    taken = [F.when(F.col("reason").isNull(), c) for c in inputs]
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in inputs])
    return ensemble_score(inspected, taken, models, forward, threshold, key).withColumn(
        "reason", F.coalesce(F.col("reason"), F.when(missing, NO_FEATURES), F.when(
            ~is_number(F.col("Probability")), NO_SCORE)))


def score_rejects(
    records: DataFrame, inputs: list[Column], models: DataFrame,
    forward: Callable[..., np.ndarray] = linear_head,
    sequence: str = "Sequence", category: str = "Fatty_acid_chain",
    allowed: list[str] = CHAINS, no_category: str = NO_CHAIN, threshold: float = 0.5, key: str | None = None,
) -> DataFrame:
    """Every record that ``score_records`` gives no prediction for, with the ``reason``."""
    scored = _scored(records, inputs, models, forward, sequence, category, allowed, no_category, threshold, key)
    return scored.where(F.col("reason").isNotNull()).select(*records.columns, "reason")


def score_file(
    spark: SparkSession, models_path: str, input_path: str, features: list[str],
    output_path: str = "predictions.csv", schema: T.StructType | str | None = None,
    rejects_path: str | None = None, **options,
) -> None:
    """Score a table file with the saved fold models and write the predictions.

    ``features`` names the columns the head takes; they are left out of the output. Records
    without a prediction go to ``rejects_path``, if given, with the reason. Every record is scored once: both
    kinds are written side by side to the checkpoint folder, and each output copies its own part.
    """
    records = require_columns(read_table(spark, input_path, schema), features)
    models = read_models(spark, models_path)
    inputs = [F.col(c) for c in features]
    if not rejects_path:
        write_table(score_records(records, inputs, models, **options).drop(*features), output_path)
        return
    predictions, rejects = score_both(records, inputs, models, **options)
    write_table(predictions.drop(*features), output_path)
    write_table(rejects.drop(*features), rejects_path)


def score_both(
    records: DataFrame, inputs: list[Column], models: DataFrame,
    forward: Callable[..., np.ndarray] = linear_head,
    sequence: str = "Sequence", category: str = "Fatty_acid_chain",
    allowed: list[str] = CHAINS, no_category: str = NO_CHAIN, threshold: float = 0.5, key: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What ``score_records`` and ``score_rejects`` give, from one pass over the records.

    The scored records are written once, in one folder for each outcome; both results read their own.
    """
    spark = records.sparkSession
    scored = _scored(records, inputs, models, forward, sequence, category, allowed, no_category, threshold, key).select(
        *records.columns, "Probability", "Prediction", "reason", F.col("reason").isNull().cast("int").alias(PREDICTED))
    folder = shared_folder(spark, "scored")
    scored.write.partitionBy(PREDICTED).parquet(folder)
    both = spark.read.schema(scored.schema).parquet(folder)
    return (both.where(F.col(PREDICTED) == 1).select(*records.columns, "Probability", "Prediction"),
            both.where(F.col(PREDICTED) == 0).select(*records.columns, "reason"))


def centroid_heads(
    df: DataFrame, fold: str, label: str, vector: str
) -> DataFrame:
    """Model table of nearest-centroid heads, one per fold, fitted on the other folds.

    The logit is ``|x - m0|^2 - |x - m1|^2`` (halved), linear in x. Each (fold, label) has one
    JVM buffer of sums, combined map-side; all later steps work on that small table. Rows without a vector, or with another
    label than 0 and 1, don't count.
    """
    sums = vector_sums(df.where(F.col(label).isin(0, 1)), [fold, label], vector).groupBy(fold, "pos").agg(*[
        F.sum(F.when(F.col(label) == v, F.col(c))).alias(f"{c[0]}{v}") for v in (0, 1) for c in ("sum", "count")])
    whole = Window.partitionBy("pos")

    def rest(name):
        return F.sum(name).over(whole) - F.coalesce(F.col(name), F.lit(0))

    pairs = sums.select(fold, "pos", *[
        F.try_divide(rest(f"s{v}"), rest(f"c{v}")).alias(f"m{v}") for v in (0, 1)])
    heads = pairs.groupBy(F.col(fold).alias("fold")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(
            "pos", (F.col("m1") - F.col("m0")).alias("w")))), lambda p: p["w"]).alias("w"),
        (F.sum(F.col("m0") * F.col("m0") - F.col("m1") * F.col("m1")) / 2).alias("b"))
    zeros = F.transform("w", lambda _: F.lit(0.0))
    return heads.select(F.col("fold").cast("int").alias("fold"), F.inline(F.array(
        F.struct(F.lit("head.weight").alias("name"),
                 F.array(F.lit(2), F.size("w")).alias("shape"),
                 F.concat(zeros, "w").alias("values")),
        F.struct(F.lit("head.bias").alias("name"), F.array(F.lit(2)).alias("shape"),
                 F.array(F.lit(0.0), F.col("b")).alias("values")))))
