"""Reading the given tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = tempfile.mkdtemp(prefix="cliplake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later plans start from the files: a lost executor costs the tasks that it ran, never
    the work before. Column pruning reaches the files. The folder is not cleared here.
    """
    path = f"{shared_folder(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def crc_fold(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


SIEVE = 1 << 20


def sieve(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``df`` without most rows whose ``key`` is not in ``wanted``, before any shuffle.

    Hash buckets of the wanted keys, at most ``SIEVE`` of them whatever the input, go to
    the driver and out again as one bitmap. Rows that pass still need a join.
    """
    buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64(key), F.lit(SIEVE)).alias("b")).distinct().collect()]
    words = [0] * (SIEVE // 32)
    for b in buckets:
        words[b >> 5] |= 1 << (b & 31)
    mask = F.broadcast(df.sparkSession.createDataFrame([(words,)], "mask array<bigint>"))  # 256 kB
    at = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    bit = F.call_function("shiftright", F.get("mask", F.floor(at / 32).cast("int")), (at % 32).cast("int"))
    return df.crossJoin(mask).where(bit.bitwiseAND(1) == 1).drop("mask")
