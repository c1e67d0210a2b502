"""Keeping catalogue tables current from an event stream.

Each micro-batch only appends what it brings: job events as they are, new videos with
their ids. The current tables are the base snapshot with these folded in, by the same
functions the batch jobs use, so a batch never rewrites the whole catalogue. A retried
batch overwrites its own folder and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from cliplake.operators.state import apply_job_events, register_videos
from cliplake.operators.stats import status_counts

EVENT_SCHEMA = "job_id bigint, seq bigint, action string, at timestamp_ntz, detail string"
NEW_VIDEO_SCHEMA = "original_path string, creation_time timestamp_ntz, id bigint"


def _changes(spark: SparkSession, folder: str, ddl: str, before: int | None = None) -> DataFrame:
    schema = T._parse_datatype_string(f"{ddl}, batch bigint")
    try:
        rows = spark.read.schema(schema).option("basePath", folder).parquet(folder)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":  # only that means that nothing is written yet
            raise
        return spark.createDataFrame([], schema)
    return rows if before is None else rows.filter(F.col("batch") < before)


def job_event_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function storing job events."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("job_id", "seq", "action", "at", "detail").write.mode("overwrite").parquet(
            f"{folder}/job_events/batch={batch_id}"
        )

    return write


def current_jobs(base: DataFrame, folder: str) -> DataFrame:
    events = _changes(base.sparkSession, f"{folder}/job_events", EVENT_SCHEMA)
    return apply_job_events(base, events.drop("batch"))


def current_status_counts(base: DataFrame, folder: str) -> DataFrame:
    return status_counts(current_jobs(base, folder))


def video_writer(base: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function registering files (original_path, creation_time) once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        known = current_videos(base, folder, before=batch_id)
        fresh = register_videos(known, batch).filter("is_new").drop("is_new")
        fresh.select("original_path", "creation_time", "id").write.mode("overwrite").parquet(
            f"{folder}/videos/batch={batch_id}"
        )

    return write


def current_videos(base: DataFrame, folder: str, before: int | None = None) -> DataFrame:
    added = _changes(base.sparkSession, f"{folder}/videos", NEW_VIDEO_SCHEMA, before)
    return base.select("original_path", "creation_time", "id").unionByName(
        added.select("original_path", "creation_time", "id")
    )


def compact_jobs(base: DataFrame, folder: str, target: str) -> None:
    """Write a new base that contains all stored events."""
    current_jobs(base, folder).write.mode("errorifexists").parquet(target)
