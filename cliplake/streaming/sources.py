"""Streaming reads of the same tables the batch jobs read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream_files(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 100
) -> DataFrame:
    """New files of a folder as a stream, at most so many per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
