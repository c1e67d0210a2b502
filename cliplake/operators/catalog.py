"""Catalogue joins, filters, lookups and ordered lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplake.functions.labels import UNTRACKED, capture_date, device_label
from cliplake.functions.predicates import contains_pattern, status_is
from cliplake.operators.ordered import top_rows


def newest(*tie: str) -> list[Column]:
    return [F.desc("created_at"), *[F.desc(t) for t in (tie or ("id",))]]


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """One row per video: its latest job by (created_at, id)."""
    cols = jobs.select("video_id", "status", "progress_percent", "created_at", "id")
    return top_rows(cols, ["video_id"], newest())


def grouped_order(device: str = "device_model") -> list[Column]:
    """Known devices first by name, newest capture first inside a device."""
    unknown = F.when(F.coalesce(F.col(device), F.lit("")) == "", 1).otherwise(0)
    return [unknown, F.asc(device), F.desc("creation_time"), F.desc("id")]


def catalogue(
    videos: DataFrame,
    jobs: DataFrame,
    search: str | None = None,
    device: str | None = None,
    status: str | None = None,
    grouped: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Videos with the status of their latest job, filtered and labelled."""
    kept = videos.filter(contains_pattern(F.col("creation_text"), search)).filter(
        contains_pattern(F.col("device_model"), device)
    )
    latest = latest_jobs(jobs).select(
        F.col("video_id"), F.col("status").alias("latest_status"), "progress_percent"
    )
    joined = kept.join(latest, kept["id"] == latest["video_id"], "left").filter(
        status_is(F.col("latest_status"), status)
    )
    if ordered:
        order = grouped_order() if grouped else [F.desc("creation_time"), F.desc("id")]
        joined = joined.orderBy(*order)
    return joined.select(
        "id",
        F.coalesce("creation_text", F.lit("")).alias("creation_time"),
        capture_date(F.col("creation_text")).alias("creation_date"),
        device_label(F.col("device_model")).alias("device"),
        "duration_seconds",
        F.coalesce("latest_status", F.lit(UNTRACKED)).alias("status"),
        "progress_percent",
        F.col("original_path").alias("path"),
    )


def active_jobs(jobs: DataFrame, videos: DataFrame, limit: int = 10) -> DataFrame:
    """Newest jobs still waiting or running, with their source path."""
    running = jobs.filter(F.col("status").isin("pending", "processing"))
    paths = videos.select(F.col("id").alias("video_id"), "original_path")
    return running.join(paths, "video_id").orderBy(*newest()).limit(limit)


def unfinished_jobs(jobs: DataFrame, resumable: bool = False) -> DataFrame:
    out = jobs.filter(F.col("status") == "processing")
    if resumable:
        out = out.filter(F.col("temp_file_path").isNotNull())
    return out.orderBy("started_at", "id")


def archive_with_paths(history: DataFrame, videos: DataFrame, limit: int = 100) -> DataFrame:
    """Newest archive entries with the current path of the video, if it still exists."""
    top = history.orderBy(F.desc("archived_at"), F.desc("id"), F.desc("video_id")).limit(limit)
    now = videos.select(F.col("id").alias("video_id"), F.col("original_path").alias("current_path"))
    return top.join(now, "video_id", "left")


def lookup(df: DataFrame, order: Sequence[Column] = (), **equals: object) -> DataFrame:
    """Rows whose columns equal the given values; the filters reach the scan."""
    for name, value in equals.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df.orderBy(*order) if order else df


def lookup_many(df: DataFrame, wanted: DataFrame, on: str, order: Sequence[Column] = ()) -> DataFrame:
    """Rows whose ``on`` is among the wanted values, with their ``place`` per value.

    ``wanted`` has one column; repeats and nulls ask nothing. Without an order every row has
    place 1. The answer to many single lookups, as one join.
    """
    asked = wanted.select(F.col(wanted.columns[0]).alias(on)).dropna().distinct()
    found = df.join(asked, on, "left_semi")
    if not order:
        return found.withColumn("place", F.lit(1))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(on).orderBy(*order)))


def newest_per(df: DataFrame, key: str) -> DataFrame:
    return top_rows(df, [key], newest())


def newest_rows(df: DataFrame, limit: int = 10) -> DataFrame:
    return df.orderBy(*newest()).limit(limit)


def project_merges(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges of every project, by date then creation."""
    return (
        links.select("project_id", "merge_job_id")
        .join(merges, links["merge_job_id"] == merges["id"])
        .orderBy("project_id", F.asc_nulls_first("date"), "created_at", "id")
    )


def project_members(projects: DataFrame, links: DataFrame, merges: DataFrame) -> DataFrame:
    """Two-hop left join: projects without merges keep one row."""
    bridge = links.select("project_id", "merge_job_id")
    items = merges.select(
        F.col("id").alias("merge_job_id"),
        "date",
        "youtube_id",
        "total_duration_seconds",
        "total_size_bytes",
        F.col("created_at").alias("merged_at"),
    )
    return projects.join(bridge, projects["id"] == bridge["project_id"], "left").join(
        items, "merge_job_id", "left"
    )


def in_id_list(df: DataFrame, ids: DataFrame, column: str = "id", negate: bool = False) -> DataFrame:
    """Keep (or drop) the rows whose key occurs in an id table."""
    keys = ids.select(ids[ids.columns[0]].alias(column))
    return df.join(keys, column, "left_anti" if negate else "left_semi")


def merge_members(merges: DataFrame, videos: DataFrame) -> DataFrame:
    """Members listed in the id array of a merge; unreadable lists give no rows."""
    members = merges.select(
        F.col("id").alias("merge_id"),
        F.posexplode(F.from_json("video_ids", "array<bigint>")).alias("position", "video_id"),
    )
    paths = videos.select(F.col("id").alias("video_id"), "original_path")
    return members.join(paths, "video_id", "left").select(
        "merge_id", "position", "video_id", "original_path"
    )


def clip_sort(key: str = "time", reverse: bool = False, device: str = "device") -> list[Column]:
    """Stable clip order: ties keep the input order, also when reversed.

    ``device`` names the column that holds the device.
    """
    keys = {
        "time": [F.col("creation_time")],
        "name": [F.lower("name")],
        "size": [F.col("size_bytes")],
        "device": [F.coalesce(device, F.lit("")), F.col("creation_time")],
    }
    parts = keys.get(key, keys["time"])
    return [*[p.desc() if reverse else p.asc() for p in parts], F.asc("idx")]
