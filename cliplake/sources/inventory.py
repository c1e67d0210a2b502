"""File inventories: recursive scans, storage roots and de-duplicated targets."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplake.functions.labels import file_suffix
from cliplake.functions.predicates import VIDEO_EXTENSIONS

# Folders below which every entry is a mounted volume.
MOUNT_PREFIXES = ("/Volumes", "/mnt")


def scan_files(
    spark: SparkSession, targets: Sequence[str] = (), extensions: Sequence[str] = VIDEO_EXTENSIONS
) -> DataFrame:
    """Files under the targets (the working folder if none), oldest first.

    Only names, times and sizes are read, never the content. A missing target is an error.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(list(targets) or [os.getcwd()])
        .select(
            F.col("path"),
            F.col("modificationTime").alias("creation_time"),
            F.col("length").alias("size_bytes"),
        )
    )
    return wanted_files(listed, extensions)


def wanted_files(listing: DataFrame, extensions: Sequence[str] = VIDEO_EXTENSIONS) -> DataFrame:
    """Rows of a listing (path, creation_time, size_bytes) with one of the suffixes, every
    path once, oldest first."""
    wanted = F.lower(file_suffix(F.col("path"))).isin(*[e.lower() for e in extensions])
    return listing.filter(wanted).dropDuplicates(["path"]).orderBy("creation_time", "path")


def storage_root(path: Column) -> Column:
    """Mounted volume of a path, the prefix itself for a file right under it, else null."""
    out = F.lit(None).cast("string")
    for prefix in MOUNT_PREFIXES:
        under = path.startswith(f"{prefix}/")
        first = F.regexp_extract(path, rf"^{prefix}/+([^/]+)", 1)
        out = F.when(
            under | (path == prefix),
            F.when(first == "", F.lit(prefix)).otherwise(F.concat(F.lit(f"{prefix}/"), first)),
        ).otherwise(out)
    return out


def storage_rollup(files: DataFrame) -> DataFrame:
    return files.groupBy(storage_root(F.col("path")).alias("root")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )


def union_targets(*listings: DataFrame) -> DataFrame:
    """Several listings as one, every path once."""
    every = reduce(lambda a, b: a.unionByName(b), listings)
    return every.groupBy("path").agg(
        F.min("creation_time").alias("creation_time"), F.max("size_bytes").alias("size_bytes")
    )
