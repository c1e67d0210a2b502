"""Display labels as column expressions (all stay inside code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and limits every report has to show unchanged.
UNKNOWN_DEVICE = "미상"
UNKNOWN_DATE = "날짜 미상"
UNTRACKED = "untracked"
STATUS_LABELS = {
    "pending": "⏳ 대기",
    "processing": "🔄 진행",
    "completed": "✅ 완료",
    "failed": "❌ 실패",
    "merged": "📦 병합됨",
}
EMPTY_PROJECT = "빈 프로젝트"
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
DESCRIPTION_LIMIT = 5000
DESCRIPTION_TAIL = "\n\n..."


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _div(c: Column, by: int) -> Column:
    return F.floor(c / F.lit(by)).cast("bigint")


def duration_label(seconds: Column) -> Column:
    """``1h 2m`` / ``2m 3s`` / ``4s`` from whole seconds."""
    t = seconds.cast("bigint")
    return (
        F.when(t >= 3600, F.concat(_div(t, 3600), F.lit("h "), _div(t % 3600, 60), F.lit("m")))
        .when(t >= 60, F.concat(_div(t, 60), F.lit("m "), t % 60, F.lit("s")))
        .otherwise(F.concat(t, F.lit("s")))
    )


def clock_label(seconds: Column, half_even: bool = False) -> Column:
    """``H:MM:SS`` or ``M:SS``; chapters round half to even, progress truncates."""
    t = (F.rint(seconds) if half_even else seconds).cast("bigint")
    minutes = _div(t % 3600, 60)
    return F.when(
        t >= 3600, F.concat(_div(t, 3600), F.lit(":"), _two(minutes), F.lit(":"), _two(t % 60))
    ).otherwise(F.concat(minutes, F.lit(":"), _two(t % 60)))


def one_decimal(value: Column) -> Column:
    """One decimal of the exact binary fraction, as ``printf`` gives it; real ties go to even.

    Ten times a value can round onto a half that the value itself is not; what the product
    lost (eight times plus two times the value, less the rounded sum) tells the side.
    """
    most, rest = value * 8, value * 2
    total = most + rest
    lost = rest - (total - most)
    tie = total - F.floor(total) == 0.5
    tenths = F.when(tie & (lost > 0), F.ceil(total)).when(tie & (lost < 0), F.floor(total)).otherwise(F.rint(total))
    return F.format_string("%.1f", tenths.cast("double") / 10)


def size_label(size: Column) -> Column:
    """1024 steps from bytes to petabytes."""
    bytes_ = size.cast("double")
    out = F.when(bytes_ < 1024, F.concat(bytes_.cast("bigint").cast("string"), F.lit(" B")))
    for power, unit in enumerate(SIZE_UNITS[1:-1], start=1):
        scaled = bytes_ / F.lit(float(1024**power))
        out = out.when(scaled < 1024, F.concat(one_decimal(scaled), F.lit(f" {unit}")))
    return out.otherwise(
        F.concat(one_decimal(bytes_ / F.lit(float(1024**5))), F.lit(f" {SIZE_UNITS[-1]}"))
    )


def path_tail(path: Column, max_len: int = 50) -> Column:
    return F.when(F.length(path) <= max_len, path).otherwise(
        F.concat(F.lit("..."), F.right(path, F.lit(max_len - 3)))
    )


def capture_date(text: Column) -> Column:
    """Calendar day of an ISO time text; ``-`` if blank, else its first ten characters."""
    compact = F.regexp_extract(text, r"^(\d{8})(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?)?$", 1)
    day = F.try_to_date(F.when(compact != "", compact), "yyyyMMdd")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("-")).otherwise(
        F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.substring(text, 1, 10))
    )


def device_label(device: Column) -> Column:
    """Blank or missing devices share one label."""
    return F.when(F.trim(F.coalesce(device, F.lit(""))) == "", F.lit(UNKNOWN_DEVICE)).otherwise(
        F.trim(device)
    )


def status_label(status: Column) -> Column:
    out = F.when(status == UNTRACKED, F.lit("-"))
    for key, label in STATUS_LABELS.items():
        out = out.when(status == key, F.lit(label))
    return out.otherwise(status)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def file_suffix(path: Column) -> Column:
    """Last extension with its dot; none for ``.hidden`` or a trailing dot."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/+[^/]*/*$", 1)


def folder_topic(path: Column, default: str = "") -> Column:
    """Struct (date, topic) of the folder a file lies in, or of the folder itself."""
    is_file = file_suffix(path) != ""
    folder = F.when(is_file, parent_folder(path)).otherwise(file_name(path))
    folder = F.when(folder.isin("", "."), F.lit(default)).otherwise(folder)
    dated = r"^(\d{4})[-_](\d{2})[-_](\d{2})\s+(.+)$"

    def split(f: Column) -> Column:
        day = F.concat_ws("-", *[F.regexp_extract(f, dated, g) for g in (1, 2, 3)])
        return F.struct(
            F.when(f.rlike(dated), day).alias("date"),
            F.coalesce(F.nullif(F.trim(F.regexp_extract(f, dated, 4)), F.lit("")), f).alias("topic"),
        )

    # an array of one binds the folder name, so that it is worked out once per row
    return F.get(F.transform(F.array(folder), split), F.lit(0))


def dated_title(title: Column) -> Column:
    """``YYYYMMDD rest`` becomes ``Y년 M월 D일 rest``."""
    pattern = r"^(\d{4})(\d{2})(\d{2})\s*(.*)$"
    rest = F.regexp_extract(title, pattern, 4)
    day = F.concat(
        F.regexp_extract(title, pattern, 1),
        F.lit("년 "),
        F.regexp_extract(title, pattern, 2).try_cast("int"),
        F.lit("월 "),
        F.regexp_extract(title, pattern, 3).try_cast("int"),
        F.lit("일"),
    )
    return F.when(
        title.rlike(pattern), F.when(rest == "", day).otherwise(F.concat(day, F.lit(" "), rest))
    ).otherwise(title)


def clean_description(text: Column) -> Column:
    """Drop angle brackets; over-long texts end at the last whole line plus an ellipsis."""
    cleaned = F.translate(text, "<>", "")
    head = F.substring(cleaned, 1, DESCRIPTION_LIMIT - len(DESCRIPTION_TAIL))
    last_break = F.length(head) - F.locate("\n", F.reverse(head))
    has_break = (F.locate("\n", F.reverse(head)) > 0) & (last_break > 0)
    kept = F.when(has_break, F.left(head, last_break)).otherwise(head)
    return F.when(F.length(cleaned) <= DESCRIPTION_LIMIT, cleaned).otherwise(
        F.concat(kept, F.lit(DESCRIPTION_TAIL))
    )


def date_range_label(start: Column, end: Column) -> Column:
    known = (F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != "")
    return (
        F.when(known & (start == end), start)
        .when(known, F.concat(start, F.lit(" ~ "), end))
        .otherwise(F.lit("-"))
    )


def project_status_label(total: Column, uploaded: Column) -> Column:
    return (
        F.when(total == 0, F.lit(EMPTY_PROJECT))
        .when(uploaded == total, F.concat(F.lit("전체 업로드 ("), total, F.lit("개)")))
        .when(uploaded > 0, F.concat(F.lit("부분 업로드 ("), uploaded, F.lit("/"), total, F.lit(")")))
        .otherwise(F.concat(F.lit("영상 "), total, F.lit("개")))
    )


def caption_text(captured: Column, location: Column, lat: Column, lon: Column) -> Column:
    """Capture day with the place, if one is known."""
    pair = F.when(
        lat.isNotNull() & lon.isNotNull(),
        F.concat(F.format_string("%.6f", lat), F.lit(", "), F.format_string("%.6f", lon)),
    )
    place = F.coalesce(location, pair)
    day = F.date_format(captured, "yyyy.MM.dd")
    return F.when(F.coalesce(place, F.lit("")) == "", day).otherwise(
        F.concat(day, F.lit(" | "), place)
    )


def subtitle_clock(seconds: Column, separator: str = ",") -> Column:
    """``HH:MM:SS,mmm``, truncated to the millisecond, never below zero."""
    ms = F.greatest((seconds * 1000).cast("bigint"), F.lit(0).cast("bigint"))
    return F.concat(
        F.format_string(
            "%02d:%02d:%02d", _div(ms, 3_600_000), _div(ms % 3_600_000, 60_000), _div(ms % 60_000, 1000)
        ),
        F.lit(separator),
        F.format_string("%03d", ms % 1000),
    )
