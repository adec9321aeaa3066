"""Scoring files as they arrive: the batch pipeline on a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from strandline.sources.tables import format_of


def stream_table(
    spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "parquet"
) -> DataFrame:
    """Unbounded table of the files that arrive in a folder."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.options(header=True, escape='"') if kind == "csv" else reader).load(folder)


def run_on_arrival(
    stream: DataFrame, step: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
) -> StreamingQuery:
    """Apply a stateless step to all files present, append the results, then stop.

    ``checkpoint`` names the progress folder: files already done are skipped next time.
    """
    return (step(stream).writeStream.format(format_of(output)).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output))
