"""Materialised small tables and joins that broadcast only after a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
PARTITION_BYTES = 128 * 1024 * 1024


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; make a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` written out as JSON text, an upper bound in practice for its rows."""
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return row[0] or 0


def fits_broadcast(settled: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a settled table is small enough to be copied to every executor."""
    return text_bytes(settled) <= max_bytes


def lookup_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Settle the lookup side of a join; hint a broadcast only if its real size allows it.

    Above the limit the table is joined by shuffle, where adaptive execution splits hot keys.
    """
    return hinted(settle(df), max_bytes)


def hinted(settled: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A settled table with a broadcast hint if it is small enough."""
    return F.broadcast(settled) if fits_broadcast(settled, max_bytes) else settled


def compact(settled: DataFrame, target_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Merge partitions down to about ``target_bytes`` each, for tables read many times.

    The size is that of the rows and of the longest array in each column; never fewer partitions
    than cores, so that no fit runs in a single task.
    """
    row = settled.agg(F.count(F.lit(1)).alias("rows"), *[
        F.max(F.size(f.name)).alias(f"__{i}") for i, f in enumerate(settled.schema.fields)
        if f.dataType.typeName() == "array"]).first()
    width = 16 * len(settled.columns) + 8 * sum(n or 0 for n in row[1:])
    wanted = -(-row.rows * width // target_bytes)
    return settled.coalesce(max(wanted, settled.sparkSession.sparkContext.defaultParallelism))


def left_lookup(
    df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left"
) -> DataFrame:
    """Join on ``keys`` with null equal to null; key columns of ``lookup`` are dropped."""
    other = {k: f"__lookup_{k}" for k in keys}
    condition = [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()]
    return df.join(lookup.withColumnsRenamed(other), condition, how).drop(*other.values())
