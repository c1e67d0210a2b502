"""Catalogue tables: columns, keys and allowed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Table layout, import order, legal values and path columns.
TABLES: dict[str, str] = {
    "projects": "id bigint, name string, description string, date_range_start string, date_range_end string,"
    " playlist_id string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "videos": "id bigint, original_path string, creation_time timestamp_ntz, duration_seconds double,"
    " device_model string, is_portrait boolean, metadata_json string, created_at timestamp_ntz",
    "transcoding_jobs": "id bigint, video_id bigint, temp_file_path string, status string, progress_percent int,"
    " started_at timestamp_ntz, completed_at timestamp_ntz, error_message string, created_at timestamp_ntz",
    "merge_jobs": "id bigint, output_path string, video_ids string, status string, youtube_id string, title string,"
    " date string, total_duration_seconds double, total_size_bytes bigint, clips_info_json string,"
    " summary_markdown string, created_at timestamp_ntz",
    "split_jobs": "id bigint, merge_job_id bigint, split_criterion string, split_value string, output_files string,"
    " youtube_ids string, error_message string, status string, created_at timestamp_ntz",
    "archive_history": "id bigint, video_id bigint, operation string, original_path string,"
    " destination_path string, archived_at timestamp_ntz",
    "backup_history": "id bigint, merge_job_id bigint, source_path string, remote string, source_type string,"
    " success boolean, error_message string, backed_up_at timestamp_ntz",
    "project_merge_jobs": "project_id bigint, merge_job_id bigint, added_at timestamp_ntz",
}
IMPORT_ORDER = tuple(TABLES)
UNIQUE_KEYS = {
    "projects": (("id",), ("name",)),
    "videos": (("id",), ("original_path",)),
    "transcoding_jobs": (("id",),),
    "merge_jobs": (("id",),),
    "split_jobs": (("id",),),
    "archive_history": (("id",),),
    "backup_history": (("id",),),
    "project_merge_jobs": (("project_id", "merge_job_id"),),
}
ALLOWED = {
    ("transcoding_jobs", "status"): ("pending", "processing", "completed", "failed", "merged"),
    ("merge_jobs", "status"): ("pending", "processing", "completed", "failed"),
    ("split_jobs", "status"): ("pending", "processing", "completed", "failed"),
    ("split_jobs", "split_criterion"): ("duration", "size"),
    ("archive_history", "operation"): ("move", "delete"),
    ("backup_history", "source_type"): ("output", "split", "timelapse", "original"),
}
# child table and column -> parent table; deleting the parent deletes the child rows
PARENTS = {
    ("transcoding_jobs", "video_id"): "videos",
    ("split_jobs", "merge_job_id"): "merge_jobs",
    ("archive_history", "video_id"): "videos",
    ("backup_history", "merge_job_id"): "merge_jobs",
    ("project_merge_jobs", "project_id"): "projects",
    ("project_merge_jobs", "merge_job_id"): "merge_jobs",
}
PATH_COLUMNS = {
    "videos": ("original_path",),
    "transcoding_jobs": ("temp_file_path",),
    "merge_jobs": ("output_path",),
    "split_jobs": ("output_files",),
    "archive_history": ("original_path", "destination_path"),
    "backup_history": ("source_path",),
}
JSON_PATH_COLUMNS = ("output_files",)
FORMAT_VERSION = 1


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[table])
