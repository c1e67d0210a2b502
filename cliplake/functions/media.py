"""Arithmetic on durations, progress, fades, colours and speeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliplake.functions.labels import file_stem, one_decimal

# Constants that decide results.
NOMINAL_FPS = 29.97
HLG_TRANSFER = "arib-std-b67"
PQ_TRANSFER = "smpte2084"
BT2020_SPACES = ("bt2020nc", "bt2020c")
THUMBNAIL_POINTS = (0.1, 0.33, 0.5)
MIN_SPEED, MAX_SPEED = 2, 60


def progress_percent(position: Column, total: Column) -> Column:
    share = ((position / total) * 100).cast("bigint")
    return F.when(total <= 0, F.lit(0).cast("bigint")).otherwise(F.least(share, F.lit(100).cast("bigint")))


def resume_position(percent: Column, total: Column) -> Column:
    return (percent / F.lit(100.0)) * total


def eta_seconds(percent: Column, position: Column, total: Column, fps: Column) -> Column:
    """Remaining seconds from the frame rate, else from the share already done."""
    left = total - position
    by_ratio = left * (F.lit(1.0) / F.try_divide(position, total) - 1)
    return (
        F.when(percent <= 0, F.lit(None).cast("double"))
        .when(percent >= 100, F.lit(0.0))
        .when(position <= 0, F.lit(None).cast("double"))
        .when(fps > 0, F.greatest(F.lit(0.0), left * F.lit(NOMINAL_FPS) / fps))
        .when(position / total > 0, by_ratio)
    )


def wall_clock_eta(percent: Column, elapsed: Column) -> Column:
    return (
        F.when(percent <= 0, F.lit(None).cast("double"))
        .when(percent >= 100, F.lit(0.0))
        .when(elapsed > 0, F.greatest(F.lit(0.0), elapsed * 100 / percent - elapsed))
    )


def fade_plan(total: Column, fade_in: Column, fade_out: Column) -> Column:
    """Struct of fades that fit into the clip, shrunk in proportion if they do not."""
    zero = F.lit(0.0)
    want_in, want_out = F.greatest(fade_in, zero), F.greatest(fade_out, zero)
    want = want_in + want_out
    shrink = F.when(total >= want, F.lit(1.0)).otherwise(total / want)
    none = (total <= 0.1) | (want <= 0)
    eff_out = want_out * shrink
    return F.struct(
        F.when(none, zero).otherwise(want_in * shrink).alias("fade_in"),
        F.when(none, zero).otherwise(eff_out).alias("fade_out"),
        F.when(none, zero).otherwise(F.greatest(total - eff_out, zero)).alias("fade_out_start"),
    )


def profile_class(transfer: Column, space: Column) -> Column:
    return (
        F.when(transfer == HLG_TRANSFER, F.lit("hdr_hlg"))
        .when(transfer == PQ_TRANSFER, F.lit("hdr_pq"))
        .when(space.isin(*BT2020_SPACES), F.lit("hdr_hlg"))
        .otherwise(F.lit("sdr"))
    )


def needs_hdr_conversion(transfer: Column) -> Column:
    return F.coalesce(transfer.isin(HLG_TRANSFER, PQ_TRANSFER), F.lit(False))


def thumbnail_points(
    path: Column, duration: Column, shares: Sequence[float] = THUMBNAIL_POINTS
) -> Column:
    """Array of (number, at_seconds, name) structs, empty for a clip without length."""
    points = F.array(
        *[
            F.struct(
                F.lit(i).alias("number"),
                (duration * F.lit(float(share))).alias("at_seconds"),
                F.concat(file_stem(path), F.lit(f"_thumb_{i:02d}.jpg")).alias("name"),
            )
            for i, share in enumerate(shares, start=1)
        ]
    )
    return F.when(duration > 0, points)


def is_portrait(rotation: Column, width: Column, height: Column) -> Column:
    return F.coalesce(rotation.isin(90, 270), F.lit(False)) | F.coalesce(width < height, F.lit(False))


def music_bed_plan(music: Column, video: Column, loop: Column, fade: float = 3.0) -> Column:
    """How a music file is fitted under a video of another length."""
    action = (
        F.when((music <= 0) | (video <= 0), F.lit("invalid"))
        .when((music < video) & loop, F.lit("loop_trim"))
        .when(music > video, F.lit("trim_fade"))
        .otherwise(F.lit("as_is"))
    )
    length = F.least(F.lit(float(fade)), video)
    return F.struct(
        action.alias("action"),
        F.when(action.isin("loop_trim", "trim_fade"), video).alias("trim_end"),
        F.when(action == "trim_fade", video - length).alias("fade_start"),
        F.when(action == "trim_fade", length).alias("fade_length"),
    )


def speed_chain(speed: Column) -> Column:
    """Tempo factors of at most 2.0 whose product is the speed; null outside 2..60.

    The number of full doublings is ``ceil(log2(speed)) - 1``; comparing with the
    powers of two keeps that exact.
    """
    valid = speed.between(MIN_SPEED, MAX_SPEED)
    doublings = sum(
        (F.when(speed > 2**k, F.lit(1)).otherwise(F.lit(0)) for k in range(1, 6)), F.lit(0)
    )
    rest = speed / F.pow(F.lit(2.0), doublings)
    chain = F.concat(F.array_repeat(F.lit("2.0"), doublings), F.array(one_decimal(rest)))
    return F.when(valid, chain)
