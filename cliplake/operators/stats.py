"""Roll-ups and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplake.functions.labels import UNKNOWN_DATE, UNKNOWN_DEVICE
from cliplake.functions.predicates import period_filter
from cliplake.operators.catalog import project_members
from cliplake.operators.ordered import number_rows, seconds_between

# Chart widths, document and packing sizes.
BAR_WIDTH = 30
SPACE_FACTOR = 1.5
IDS_PER_ROW = 1000


def _zero(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.lit(0).cast(kind))


def _count_if(cond: Column) -> Column:
    return F.count_if(cond)


def video_totals(videos: DataFrame, period: str | None = None) -> DataFrame:
    return videos.filter(period_filter(F.col("creation_time"), period)).agg(
        F.count(F.lit(1)).alias("total_videos"),
        _zero(F.sum("duration_seconds"), "double").alias("total_duration"),
    )


def device_distribution(videos: DataFrame, period: str | None = None) -> DataFrame:
    """Counts per device; only missing devices are relabelled, blank ones stay blank."""
    return (
        videos.filter(period_filter(F.col("creation_time"), period))
        .groupBy(F.coalesce("device_model", F.lit(UNKNOWN_DEVICE)).alias("device"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def status_counts(jobs: DataFrame, period: str | None = None) -> DataFrame:
    return (
        jobs.filter(period_filter(F.col("created_at"), period))
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def transcode_summary(jobs: DataFrame, period: str | None = None) -> DataFrame:
    s = F.col("status")
    out = jobs.filter(period_filter(F.col("created_at"), period)).agg(
        _count_if(s.isin("completed", "merged")).alias("completed"),
        _count_if(s == "failed").alias("failed"),
        _count_if(s == "pending").alias("pending"),
        _count_if(s == "processing").alias("processing"),
        F.count(F.lit(1)).alias("total"),
    )
    return out.withColumn("success_rate", F.try_divide(F.col("completed") * F.lit(100.0), F.col("total")))


def average_speed(jobs: DataFrame, videos: DataFrame, period: str | None = None) -> DataFrame:
    """Mean of duration over elapsed time of finished jobs; nothing (or 0) gives null."""
    done = jobs.filter(period_filter(F.col("created_at"), period)).filter(
        F.col("status").isin("completed", "merged") & (F.col("completed_at") > F.col("started_at"))
    )
    lengths = videos.filter(F.col("duration_seconds") > 0).select(
        F.col("id").alias("video_id"), "duration_seconds"
    )
    elapsed = seconds_between(F.col("started_at"), F.col("completed_at"))
    joined = done.select("video_id", elapsed.alias("elapsed")).join(lengths, "video_id")
    speed = F.avg(F.col("duration_seconds") / F.greatest(F.col("elapsed"), F.lit(0.001)))
    return joined.agg(F.nullif(speed, F.lit(0.0)).alias("avg_speed"))


def merge_rollup(merges: DataFrame, period: str | None = None) -> DataFrame:
    return merges.filter(period_filter(F.col("created_at"), period)).agg(
        F.count(F.lit(1)).alias("merge_total"),
        _count_if(F.col("status") == "completed").alias("merge_completed"),
        _count_if(F.col("status") == "failed").alias("merge_failed"),
        F.count("youtube_id").alias("merge_uploaded"),
        _zero(F.sum("total_size_bytes"), "bigint").alias("merge_size_bytes"),
        _zero(F.sum("total_duration_seconds"), "double").alias("merge_duration"),
    )


def archive_counts(history: DataFrame, period: str | None = None) -> DataFrame:
    return history.filter(period_filter(F.col("archived_at"), period)).agg(
        _count_if(F.col("operation") == "move").alias("moved"),
        _count_if(F.col("operation") == "delete").alias("deleted"),
    )


def backup_counts(history: DataFrame, period: str | None = None) -> DataFrame:
    return history.filter(period_filter(F.col("backed_up_at"), period)).agg(
        _count_if(F.col("success")).alias("backups_ok"),
        _count_if(~F.col("success")).alias("backups_failed"),
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Put several one-row frames side by side: a union of their rows, then one aggregate."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def dashboard(
    videos: DataFrame, jobs: DataFrame, merges: DataFrame, archive: DataFrame, period: str | None = None
) -> DataFrame:
    """All statistics of one period as a single row."""
    devices = device_distribution(videos, period).agg(
        F.count(F.lit(1)).alias("device_count"),
        F.max_by("device", F.struct(F.col("cnt"), F.col("device"))).alias("top_device"),
    )
    return one_row(
        video_totals(videos, period),
        devices,
        transcode_summary(jobs, period),
        average_speed(jobs, videos, period),
        merge_rollup(merges, period),
        archive_counts(archive, period),
    )


def dashboard_devices(videos: DataFrame, period: str | None = None) -> DataFrame:
    """The device list of the dashboard: (place, device, cnt), most videos first, then by name.

    A row for each device, as a list in one row would grow with the table.
    """
    counted = device_distribution(videos, period).withColumn("__less", -F.col("cnt"))
    return number_rows(counted, [], ["__less", "device"], None, "place").select("place", "device", "cnt")


def project_rollup(projects: DataFrame, links: DataFrame, merges: DataFrame) -> DataFrame:
    """Counts, length, size and uploads per project; empty projects stay.

    Merges are joined to the bridge and summed per project before the projects
    come in, so a project with very many merges is combined on the map side.
    """
    items = merges.select(
        F.col("id").alias("merge_job_id"), "total_duration_seconds", "total_size_bytes", "youtube_id"
    )
    per = (
        links.select("project_id", "merge_job_id")
        .join(items, "merge_job_id", "left")
        .groupBy("project_id")
        .agg(
            F.count("merge_job_id").alias("total_count"),
            F.sum("total_duration_seconds").alias("d"),
            F.sum("total_size_bytes").alias("s"),
            F.count("youtube_id").alias("u"),
        )
    )
    return projects.join(per, projects["id"] == per["project_id"], "left").select(
        *[projects[c] for c in projects.columns],
        _zero(F.col("total_count"), "bigint").alias("total_count"),
        _zero(F.col("d"), "double").alias("total_duration_seconds"),
        _zero(F.col("s"), "bigint").alias("total_size_bytes"),
        _zero(F.col("u"), "bigint").alias("uploaded_count"),
    )


def project_date_range(links: DataFrame, merges: DataFrame) -> DataFrame:
    dates = merges.select(F.col("id").alias("merge_job_id"), "date")
    return (
        links.select("project_id", "merge_job_id")
        .join(dates, "merge_job_id", "left")
        .groupBy("project_id")
        .agg(F.min("date").alias("date_range_start"), F.max("date").alias("date_range_end"))
    )


def project_detail(projects: DataFrame, links: DataFrame, merges: DataFrame) -> DataFrame:
    """Totals of every project; null and zero values do not count, blank ids are not uploads."""
    rows = project_members(projects.select("id", "name"), links, merges)
    return rows.groupBy("id", "name").agg(
        F.count("merge_job_id").alias("total_count"),
        _zero(F.sum("total_duration_seconds"), "double").alias("total_duration_seconds"),
        _zero(F.sum("total_size_bytes"), "bigint").alias("total_size_bytes"),
        _count_if(F.coalesce("youtube_id", F.lit("")) != "").alias("uploaded_count"),
    )


def pages(rows: DataFrame, keys: list[str], order: list[str], per_page: int) -> DataFrame:
    """Add ``part``: the rank of a row within its keys, in pages of ``per_page`` rows.

    Ranks come from range blocks, so a key of any size is ranked by many tasks.
    """
    if per_page < 1:
        raise ValueError("a page needs at least one row")
    ranked = number_rows(rows, keys, order, None, "__rank")
    return ranked.withColumn("part", F.floor((F.col("__rank") - 1) / F.lit(per_page)).cast("bigint")).drop("__rank")


def project_dates(
    links: DataFrame, merges: DataFrame, ids_per_row: int = IDS_PER_ROW
) -> DataFrame:
    """Merge ids of a project by date, packed into rows of bounded size.

    The ids of a date are ranked; each row (``part`` 0, 1, ..) holds the next ``ids_per_row`` of
    them, whatever the ids look like, so no array grows with the data.
    """
    items = merges.select(
        F.col("id").alias("merge_job_id"),
        F.when(F.coalesce("date", F.lit("")) == "", F.lit(UNKNOWN_DATE)).otherwise(F.col("date")).alias("date"),
    )
    rows = links.select("project_id", "merge_job_id").join(items, "merge_job_id")
    return (
        pages(rows, ["project_id", "date"], ["merge_job_id"], ids_per_row)
        .groupBy("project_id", "date", "part")
        .agg(
            F.count(F.lit(1)).alias("merge_count"),
            F.array_sort(F.collect_list("merge_job_id")).alias("merge_ids"),
        )
    )


def catalogue_summary(items: DataFrame) -> DataFrame:
    """Total and date span of catalogue items (device counts: :func:`device_counts`)."""
    day = F.try_to_date("creation_date", "yyyy-MM-dd")
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        F.min(day).alias("date_start"),
        F.max(day).alias("date_end"),
    )


def device_counts(items: DataFrame) -> DataFrame:
    return (
        items.groupBy("device")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), F.lower("device"), "device")
    )


def table_counts(videos: DataFrame, merges: DataFrame, projects: DataFrame) -> DataFrame:
    return one_row(
        videos.agg(F.count(F.lit(1)).alias("videos")),
        merges.agg(F.count(F.lit(1)).alias("merges"), F.count("youtube_id").alias("uploaded")),
        projects.agg(F.count(F.lit(1)).alias("projects")),
    )


def device_shares(distribution: DataFrame, width: int = BAR_WIDTH) -> DataFrame:
    """Share and bar lengths per device, from its counts.

    Total and maximum come from a one-row aggregate that is broadcast.
    """
    whole = distribution.agg(F.sum("cnt").alias("total"), F.max("cnt").alias("top"))
    n = F.col("cnt")
    return distribution.join(F.broadcast(whole), F.lit(True)).select(
        "device",
        "cnt",
        (n * F.lit(100.0) / F.col("total")).alias("percent"),
        F.greatest(F.lit(1).cast("bigint"), F.floor(n / F.col("top") * width).cast("bigint")).alias("bar"),
        F.floor(F.lit(width) * n / F.col("total")).cast("bigint").alias("share_bar"),
    )


def space_estimate(files: DataFrame, by: str, factor: float = SPACE_FACTOR) -> DataFrame:
    return files.groupBy(by).agg(
        F.floor(F.sum("size_bytes") * F.lit(factor)).cast("bigint").alias("required_bytes")
    )
