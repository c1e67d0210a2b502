"""Row filters and rule columns."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliplake.functions.labels import UNTRACKED, file_suffix, one_decimal

# Accepted extensions, statuses and upload limits.
VIDEO_EXTENSIONS = (".mp4", ".mov", ".mts", ".m4v", ".mkv", ".avi", ".webm", ".m2ts", ".mxf")
AUDIO_EXTENSIONS = (".aac", ".aif", ".aiff", ".flac", ".m4a", ".mp3", ".wav", ".wave")
JOB_STATUSES = ("pending", "processing", "completed", "failed", "merged")
STATUS_SENTINEL = "__show__"
UPLOAD_MAX_BYTES = 256 * 1024**3
UPLOAD_MAX_SECONDS = 12 * 60 * 60
UPLOAD_WARN_SHARE = 0.9
UPLOAD_MESSAGES = {
    "size": ("파일 크기 초과 (", "GB 초과)"),
    "size_near": "파일 크기가 제한에 근접함",
    "length": ("영상 길이 초과 (", "시간 초과)"),
    "length_near": "영상 길이가 제한에 근접함",
    "length_unknown": "영상 길이를 확인할 수 없음 (ffprobe 필요)",
}


def contains_pattern(column: Column, pattern: str | None) -> Column:
    """Case-insensitive text search; ``%`` and ``_`` stay wildcards, blank means no filter."""
    if pattern is None or not pattern.strip():
        return F.lit(True)
    escaped = pattern.strip().replace("\\", "\\\\")
    return column.ilike(f"%{escaped}%")


def normal_status(status: str | None) -> str | None:
    """Lower-cased status filter, None for no filter, ValueError for an unknown one."""
    if status is None or status == STATUS_SENTINEL:
        return None
    value = status.strip().lower()
    if value == "":
        return None
    if value not in (*JOB_STATUSES, UNTRACKED):
        raise ValueError(f"status must be one of {', '.join((*JOB_STATUSES, UNTRACKED))}")
    return value


def status_is(latest: Column, status: str | None) -> Column:
    value = normal_status(status)
    if value is None:
        return F.lit(True)
    return latest.isNull() if value == UNTRACKED else latest == value


def period_filter(column: Column, period: str | None, timestamp: bool = True) -> Column:
    """Prefix filter on a time; whole years, months and days become a range the scan can use."""
    if not period:
        return F.lit(True)
    if not timestamp:
        return F.lower(column).startswith(period.lower())
    m = re.fullmatch(r"(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", period)
    if m is None:
        return F.lower(column.cast("string")).startswith(period.lower().replace("t", " "))
    year, month, day = m.group(1), m.group(2), m.group(3)
    start = f"{year}-{month or '01'}-{day or '01'}"
    step = {1: "1 year", 2: "1 month", 3: "1 day"}[1 + (month is not None) + (day is not None)]
    low = F.expr(f"timestamp_ntz'{start} 00:00:00'")
    return (column >= low) & (column < low + F.expr(f"interval {step}"))


def glob_to_regex(pattern: str) -> str:
    """Shell wildcards as an anchored Java regex."""
    return "^" + fnmatch.translate(pattern).removesuffix("\\Z").removesuffix("\\z") + "\\z"


def matches_any_glob(name: Column, patterns: Sequence[str]) -> Column:
    """True if the name, or its lower-cased form, fits one of the patterns."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | name.rlike(glob_to_regex(pattern)) | F.lower(name).rlike(
            glob_to_regex(pattern.lower())
        )
    return hit


def glob_filter(
    name: Column, include_only: Sequence[str] = (), exclude: Sequence[str] = ()
) -> Column:
    keep = matches_any_glob(name, include_only) if include_only else F.lit(True)
    return keep & ~matches_any_glob(name, exclude) if exclude else keep


def ingest_reason(path: Column, size: Column) -> Column:
    """Null for a file that may be ingested, else why not."""
    return (
        F.when(~F.lower(file_suffix(path)).isin(*VIDEO_EXTENSIONS), F.lit("unsupported extension"))
        .when(size == 0, F.lit("empty file"))
    )


def needs_device_scan(device: Column, heuristic: bool = False) -> Column:
    rule = device.isNull() | (device == "")
    if heuristic:
        rule = rule | (device == "Nikon") | device.ilike("Apple iPhone%")
    return rule


def upload_check(size: Column, duration: Column) -> Column:
    """Struct (is_valid, errors, warnings) against the upload limits."""
    msg = UPLOAD_MESSAGES
    over_gb = (size - F.lit(UPLOAD_MAX_BYTES)) / F.lit(float(1024**3))
    over_h = (duration - F.lit(float(UPLOAD_MAX_SECONDS))) / F.lit(3600.0)
    too_big, too_long = size > UPLOAD_MAX_BYTES, duration > UPLOAD_MAX_SECONDS
    errors = F.array_compact(
        F.array(
            F.when(too_big, F.concat(F.lit(msg["size"][0]), one_decimal(over_gb), F.lit(msg["size"][1]))),
            F.when(too_long, F.concat(F.lit(msg["length"][0]), one_decimal(over_h), F.lit(msg["length"][1]))),
        )
    )
    near_size = ~too_big & (size > F.lit(UPLOAD_MAX_BYTES * UPLOAD_WARN_SHARE))
    near_length = ~too_long & (duration > F.lit(UPLOAD_MAX_SECONDS * UPLOAD_WARN_SHARE))
    warnings = F.array_compact(
        F.array(
            F.when(near_size, F.lit(msg["size_near"])),
            F.when(near_length, F.lit(msg["length_near"])),
            F.when(duration == 0, F.lit(msg["length_unknown"])),
        )
    )
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"))


def metadata_faults(
    width: Column, height: Column, duration: Column, fps: Column, lat: Column, lon: Column
) -> Column:
    """Names of the fields outside their legal range."""
    return F.array_compact(
        F.array(
            F.when(width <= 0, F.lit("width")),
            F.when(height <= 0, F.lit("height")),
            F.when(duration <= 0, F.lit("duration")),
            F.when(fps <= 0, F.lit("fps")),
            F.when(~lat.between(-90, 90), F.lit("latitude")),
            F.when(~lon.between(-180, 180), F.lit("longitude")),
        )
    )
