"""Model parameters as a table: ``fold``, ``name``, ``shape``, ``values``."""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.sources.store import Folder

MODEL_SCHEMA = "fold int, name string, shape array<int>, values array<double>"
NO_MODEL = "the model table holds no fold model"
MAX_MODEL_NUMBERS = 4 * 1024 * 1024  # 32 MB as doubles
WORST = -1.0  # a first model has to score over this


def model_rows(fold: int, parameters: dict[str, np.ndarray]) -> list[tuple]:
    """Rows of the model table for the parameters of one fold."""
    return [(fold, name, list(np.shape(p)), np.ravel(p).astype(float).tolist())
            for name, p in parameters.items()]


def save_fold(models: DataFrame, path: str) -> None:
    """Write the parameters of the given folds, replacing earlier ones of these folds only."""
    models.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "fold").parquet(path)


def _published(folder: Folder) -> tuple[int, dict[int, dict]]:
    """The number for the next list, and what the newest whole list says of every fold."""
    numbers = folder.numbers()
    for number in reversed(numbers):
        held = folder.read(number)
        if held is not None:
            return numbers[-1] + 1, {int(fold): entry for fold, entry in held["folds"].items()}
    return (numbers[-1] + 1 if numbers else 0), {}


def publish_best(models: DataFrame, scores: dict[int, float], path: str, least: float = WORST) -> list[int]:
    """Make the given folds' models the current ones where their score beats the published one; returns these folds.

    A score has to be over that of the published model, or over ``least`` where there is none; null and NaN scores never are.
    Parameters go to a folder of their own; then a new list of current folders is made under the next number, which only
    one writer can create. A writer that comes second compares again with what the first has published. So a run killed
    halfway, or a worse one, leaves the current models readable as they were.
    """
    folder, fresh = Folder(models.sparkSession, f"{path}/lists"), f"models/{uuid.uuid4().hex}"
    written: set[int] = set()
    while True:
        number, current = _published(folder)
        better = sorted(fold for fold, score in scores.items() if score is not None and not math.isnan(score)
                        and score > current.get(fold, {"score": least})["score"])
        if not better:
            return []
        if not written:
            written = set(better)
            models.where(F.col("fold").isin(better)).write.partitionBy("fold").parquet(f"{path}/{fresh}")
        # Scores only rise, so what is better now was better when the parameters were written.
        listed = current | {fold: {"score": float(scores[fold]), "folder": fresh} for fold in better}
        if folder.create(number, {"folds": {str(fold): entry for fold, entry in sorted(listed.items())}}):
            return better


def published_scores(spark: SparkSession, path: str) -> dict[int, float]:
    """Score of every fold's current model."""
    return {fold: entry["score"] for fold, entry in sorted(_published(Folder(spark, f"{path}/lists"))[1].items())}


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Read the current models of ``publish_best``, or else a table of ``save_fold``."""
    current = _published(Folder(spark, f"{path}/lists"))[1]
    if not current:
        return spark.read.schema(MODEL_SCHEMA).parquet(path)
    folders: dict[str, list[int]] = {}
    for fold, entry in current.items():
        folders.setdefault(entry["folder"], []).append(fold)
    return reduce(DataFrame.unionByName, [
        spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/{name}").where(F.col("fold").isin(folds))
        for name, folds in sorted(folders.items())])


def list_folds(models: DataFrame) -> list[int]:
    """Folds that have a model, in order; an error when there is none."""
    folds = [r.fold for r in models.select("fold").distinct().orderBy("fold").collect()]
    if not folds:
        raise ValueError(NO_MODEL)
    return folds


def load_folds(models: DataFrame) -> list[dict[str, np.ndarray]]:
    """Parameters of every fold of the table as numpy arrays, in fold order."""
    table = models.select("fold", "name", "shape", "values").orderBy("fold", "name").toArrow()
    folds: dict[int, dict[str, np.ndarray]] = {}
    keys = zip(*(table[c].to_pylist() for c in ("fold", "name", "shape")))
    for (fold, name, shape), values in zip(keys, table["values"]):
        folds.setdefault(fold, {})[name] = values.values.to_numpy().reshape(shape)
    return list(folds.values())


def model_numbers(models: DataFrame) -> int:
    """Parameters of all folds together."""
    return models.agg(F.sum(F.size("values").cast("long"))).first()[0] or 0


def fold_groups(
    models: DataFrame, max_numbers: int = MAX_MODEL_NUMBERS, strict: bool = False,
) -> list[list[int]]:
    """Folds grouped so that the parameters of a group stay within ``max_numbers``.

    A group is broadcast as a whole; a single fold is the smallest unit. Fails when the
    table holds no model, and if ``strict`` on a fold of more than ``max_numbers`` parameters.
    """
    sizes = models.groupBy("fold").agg(
        F.sum(F.size("values").cast("long")).alias("numbers")).orderBy("fold").collect()
    if not sizes:
        raise ValueError(NO_MODEL)
    groups, used = [], max_numbers
    for row in sizes:
        if strict and row.numbers > max_numbers:
            raise ValueError(f"fold {row.fold} has {row.numbers} parameters, more than the {max_numbers} that are sent to a "
                             "task; linear heads are scored in blocks if a key is given")
        if used + row.numbers > max_numbers:
            groups.append([])
            used = 0
        groups[-1].append(row.fold)
        used += row.numbers
    return groups
