"""Report rows as JSON or CSV text, and the files made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.functions.labels import UNKNOWN_DATE
from cliplake.operators.stats import pages, project_detail, project_rollup

# Column order of the catalogue report.
CSV_COLUMNS = (
    "id",
    "creation_date",
    "creation_time",
    "device",
    "duration_seconds",
    "status",
    "progress_percent",
    "path",
)
JSON_COLUMNS = (
    "id",
    "creation_time",
    "creation_date",
    "device",
    "duration_seconds",
    "status",
    "progress_percent",
    "path",
)
KEEP_NULLS = {"ignoreNullFields": "false"}
MERGES_PER_DOCUMENT = 1000


def catalogue_json(items: DataFrame) -> DataFrame:
    return items.select("id", F.to_json(F.struct(*JSON_COLUMNS), KEEP_NULLS).alias("item"))


def catalogue_csv(items: DataFrame) -> DataFrame:
    """CSV lines without the header, nulls as empty fields."""
    return items.select("id", F.to_csv(F.struct(*CSV_COLUMNS), {"nullValue": "", "emptyValue": ""}).alias("line"))


def write_catalogue(items: DataFrame, folder: str, fmt: str, summary: DataFrame | None = None) -> None:
    """Write the report: ``csv`` with its fixed header, or ``json`` items beside their summary."""
    if fmt == "csv":
        items.select(*CSV_COLUMNS).write.mode("errorifexists").option("header", True).option("nullValue", "").option(
            "emptyValue", ""
        ).csv(folder)
        return
    if fmt != "json":
        raise ValueError("fmt must be csv or json")
    items.select(*JSON_COLUMNS).write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{folder}/items")
    if summary is not None:
        summary.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{folder}/summary")


def project_list_json(projects: DataFrame, links: DataFrame, merges: DataFrame) -> DataFrame:
    rolled = project_rollup(projects, links, merges)
    return rolled.select(
        "id",
        F.to_json(
            F.struct(
                "id",
                "name",
                "description",
                F.col("total_count").alias("merge_job_count"),
                "total_duration_seconds",
                "uploaded_count",
            ),
            KEEP_NULLS,
        ).alias("item"),
    )


def project_detail_json(
    projects: DataFrame, links: DataFrame, merges: DataFrame, per_document: int = MERGES_PER_DOCUMENT
) -> DataFrame:
    """Detail of every project as (project_id, section, part, body) documents.

    Sections: the summary, the merges by id, and the merge ids by date. Documents hold
    ``per_document`` merges each, so that a project with very many becomes many documents
    and no row grows without limit; a date that goes on in the next document is named in both.
    """
    detail = project_detail(projects, links, merges).select(
        F.col("id").alias("project_id"),
        F.lit("summary").alias("section"),
        F.lit(0).cast("bigint").alias("part"),
        F.to_json(F.struct("id", "name", "total_count", "uploaded_count", "total_size_bytes")).alias("body"),
    )
    linked = links.select("project_id", "merge_job_id").join(merges.withColumnRenamed("id", "merge_job_id"), "merge_job_id")
    listed = (
        pages(linked, ["project_id"], ["merge_job_id"], per_document)
        .groupBy("project_id", "part")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("merge_job_id").alias("id"), "title", "date", F.col("total_size_bytes").alias("size_bytes"), "youtube_id", "output_path"
                    )
                )
            ).alias("m")
        )
        .select("project_id", F.lit("merge_jobs").alias("section"), "part", F.to_json("m", KEEP_NULLS).alias("body"))
    )
    day = F.when(F.coalesce("date", F.lit("")) == "", F.lit(UNKNOWN_DATE)).otherwise(F.col("date"))
    dates = (
        pages(linked.select("project_id", day.alias("date"), "merge_job_id"), ["project_id"], ["date", "merge_job_id"], per_document)
        .groupBy("project_id", "part", "date")
        .agg(F.array_sort(F.collect_list("merge_job_id")).alias("merge_ids"))
        .groupBy("project_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("date", "merge_ids"))).alias("d"))
        .select(
            "project_id",
            F.lit("date_groups").alias("section"),
            "part",
            F.to_json(F.map_from_entries("d")).alias("body"),
        )
    )
    return detail.unionByName(listed).unionByName(dates)
