"""Verdicts over batches of media files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.operators.ordered import group_values

# Comparison order, target profile and tolerances.
COMPARED_FIELDS = (
    "codec",
    "pixel_format",
    "width",
    "height",
    "sar",
    "color_space",
    "color_transfer",
    "color_primaries",
    "audio_codec",
    "audio_sample_rate",
    "audio_channels",
    "audio_stream_count",
    "has_audio",
    "is_portrait",
)
TARGET_CODEC = "hevc"
TARGET_PIXEL_FORMATS = ("p010le", "yuv420p10le")
TARGET_WIDTH, TARGET_HEIGHT = 3840, 2160
TARGET_FPS = 30000 / 1001
FPS_TOLERANCE = 0.05
TARGET_AUDIO_CODEC = "aac"
TARGET_AUDIO_RATE = 48000
DRIFT_TOLERANCE_SECONDS = 5.0


def homogeneity(files: DataFrame) -> DataFrame:
    """Per batch: may its files be joined without re-encoding, and if not, why.

    The reason is the first difference to the batch's first file (by file, then by
    field order, fps last), else the first target rule the first file breaks.
    """
    first = F.min_by(F.struct(*COMPARED_FIELDS, "fps", "is_vfr"), "idx")
    rows = group_values(files, ["batch"], first=first)
    differs = [
        F.when(~F.col(name).eqNullSafe(F.col(f"first.{name}")), F.lit(i))
        for i, name in enumerate(COMPARED_FIELDS)
    ]
    fps_differs = F.when(F.abs(F.col("fps") - F.col("first.fps")) > FPS_TOLERANCE, F.lit(len(COMPARED_FIELDS)))
    field = F.coalesce(*differs, fps_differs)
    per = rows.groupBy("batch").agg(
        F.min(F.when(field.isNotNull(), F.struct("idx", field.alias("field")))).alias("mismatch"),
        F.min_by("first", "idx").alias("f"),
        F.count(F.lit(1)).alias("files"),
    )
    names = F.array(*[F.lit(n) for n in (*COMPARED_FIELDS, "fps")])

    def f(name: str):
        return F.col(f"f.{name}")

    def not_709(name: str):
        return f(name).isNotNull() & (f(name) != "bt709")

    reason = (
        F.when(
            F.col("mismatch").isNotNull(),
            F.concat(F.lit("heterogeneous "), F.get(names, F.col("mismatch.field")), F.lit(" across inputs")),
        )
        .when(~f("codec").eqNullSafe(F.lit(TARGET_CODEC)), F.lit("video codec"))
        .when(~F.coalesce(f("pixel_format").isin(*TARGET_PIXEL_FORMATS), F.lit(False)), F.lit("pixel format"))
        .when((f("width") != TARGET_WIDTH) | (f("height") != TARGET_HEIGHT), F.lit("resolution"))
        .when(F.abs(f("fps") - TARGET_FPS) > FPS_TOLERANCE, F.lit("fps"))
        .when(f("is_portrait"), F.lit("portrait orientation"))
        .when(f("is_vfr"), F.lit("variable frame rate"))
        .when(not_709("color_transfer"), F.lit("color transfer"))
        .when(not_709("color_space"), F.lit("color space"))
        .when(not_709("color_primaries"), F.lit("color primaries"))
        .when(f("sar").isNotNull() & (f("sar") != "1:1"), F.lit("non-square pixels"))
        .when(f("has_audio") & ~f("audio_codec").eqNullSafe(F.lit(TARGET_AUDIO_CODEC)), F.lit("audio codec"))
        .when(
            f("has_audio") & ~f("audio_sample_rate").eqNullSafe(F.lit(TARGET_AUDIO_RATE)), F.lit("sample rate")
        )
        .when(f("audio_stream_count") > 1, F.lit("multi-track audio"))
    )
    return per.select("batch", "files", reason.isNull().alias("eligible"), reason.alias("reason"))


def sample_rate_mismatch(files: DataFrame) -> DataFrame:
    """Per batch: distinct known sample rates, and whether there is more than one."""
    rates = files.filter("audio_sample_rate IS NOT NULL").select("batch", "audio_sample_rate").distinct()
    return rates.groupBy("batch").agg(
        F.array_sort(F.collect_list("audio_sample_rate")).alias("rates"),
        (F.count(F.lit(1)) > 1).alias("mismatch"),
    )


def duration_drift(streams: DataFrame) -> DataFrame:
    """Gap between video and audio length from rows (media_id, stream_no, codec_type, duration).

    The last readable duration per type counts; without both there is no verdict.
    """
    value = F.col("duration").try_cast("double")
    last = (
        streams.withColumn("d", value)
        .filter("d IS NOT NULL")
        .groupBy("media_id")
        .pivot("codec_type", ["video", "audio"])
        .agg(F.max_by("d", "stream_no"))
    )
    gap = F.abs(F.col("video") - F.col("audio"))
    return last.select(
        "media_id",
        F.col("video").alias("video_s"),
        F.col("audio").alias("audio_s"),
        gap.alias("gap_s"),
        F.when(gap.isNull(), F.lit("not comparable"))
        .when(gap > DRIFT_TOLERANCE_SECONDS, F.lit("mismatch"))
        .otherwise(F.lit("ok"))
        .alias("verdict"),
    )
