"""Linear heads with more parameters than a task should be sent: matrix blocks joined to blocks of the rows' vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.vectors import to_matrix
from strandline.plans.sizing import lookup_side, settle
from strandline.sources.models import NO_MODEL

BLOCK = 4096
TASK_ROWS = 4096


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return to_matrix(column.combine_chunks())


def _multiply(vectors: pa.Table, weights: pa.Table) -> pa.Table:
    """Products of one block of the vectors with the same block of all heads; heads in order of ``head``."""
    weights = weights.sort_by("head")
    found = _matrix(vectors["x"]).astype(np.float64) @ _matrix(weights["w"]).T
    parts = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))
    return pa.table({"__key": vectors["__key"], "partial": parts})


def blocked_logits(rows: DataFrame, key: str, vector: Column, models: DataFrame, block: int = BLOCK,
                   task_rows: int = TASK_ROWS) -> DataFrame:
    """``key`` and ``logits``, two per fold in order, from linear heads of any width.

    Vectors and weights are cut into blocks of ``block`` numbers. A task multiplies one block of up to about ``task_rows`` vectors
    with that block of all folds; the partial products of a row are summed map-side. Nothing is broadcast but the biases. ``key`` has
    to be unique; rows without a vector, with a null in it or of another width than the heads have no logits.
    """
    heads = settle(models.where("name = 'head.weight'").select(
        "fold", F.element_at("shape", 1).alias("outs"), F.element_at("shape", 2).alias("width"), "values"))
    shapes = heads.select("fold", "outs", "width").orderBy("fold").collect()
    if not shapes:
        raise ValueError(NO_MODEL)
    if len({(s.outs, s.width) for s in shapes}) != 1:
        raise ValueError("the heads differ in shape")
    outs, width = shapes[0].outs, shapes[0].width
    blocks = -(-width // block)
    place = {s.fold: i for i, s in enumerate(shapes)}
    order = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    whole = F.col("vector").isNotNull() & (F.size("vector") == width) & F.forall("vector", lambda v: v.isNotNull())
    wide = rows.select(F.col(key).alias("__key"), vector.alias("vector")).where(whole)
    pieces = max(1, -(-rows.count() // task_rows))

    def cut(start: Column) -> Column:
        return F.slice(F.col("vector"), start * block + 1, F.least(F.lit(block), width - start * block))

    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    vectors = wide.select("__key", F.pmod(F.xxhash64("__key"), F.lit(pieces)).cast("int").alias("piece"), "vector",
                          F.explode(numbers).alias("block")).select("__key", "piece", "block", cut(F.col("block")).alias("x"))
    first = F.col("out") * width + F.col("block") * block
    weights = heads.select("fold", "values", F.explode(F.sequence(F.lit(0), F.lit(outs - 1))).alias("out")).select(
        "fold", "values", "out", F.explode(numbers).alias("block")).select(
        "block", (order[F.col("fold")] * outs + F.col("out")).alias("head"),
        F.slice("values", first + 1, F.least(F.lit(block), width - F.col("block") * block)).alias("w")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    kind = rows.schema[key].dataType.simpleString()
    products = vectors.groupBy("block", "piece").cogroup(weights.groupBy("block", "piece")).applyInArrow(
        _multiply_or_none, f"__key {kind}, partial array<double>")
    sums = products.select("__key", array_to_vector("partial").alias("p")).groupBy("__key").agg(
        vector_to_array(Summarizer.sum(F.col("p"))).alias("sums"))
    biases = [r["values"] for r in models.where("name = 'head.bias'").orderBy("fold").select("values").collect()]
    bias = F.array(*[F.lit(float(b)) for values in biases for b in values])
    return sums.select(F.col("__key").alias(key), F.zip_with("sums", bias, lambda a, b: a + b).alias("logits"))


def _multiply_or_none(vectors: pa.Table, weights: pa.Table) -> pa.Table:
    """No rows where a block of the heads meets no vectors."""
    if not vectors.num_rows:
        return pa.table({"__key": vectors["__key"], "partial": pa.array([], pa.list_(pa.float64()))})
    return _multiply(vectors, weights)


def with_logits(df: DataFrame, key: str, vector: Column, models: DataFrame, name: str, block: int = BLOCK,
                task_rows: int = TASK_ROWS) -> DataFrame:
    """All rows with their logits, null where they have none; logits are looked up where they are few."""
    found = lookup_side(blocked_logits(df, key, vector, models, block, task_rows).withColumnsRenamed(
        {key: "__key", "logits": name}))
    return df.join(found, F.col(key) == F.col("__key"), "left").drop("__key")
