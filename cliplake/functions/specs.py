"""User-entered specifications parsed by expressions; invalid input becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted units and presets.
SIZE_FACTORS = {"": 1, "B": 1, "K": 1024, "M": 1024**2, "G": 1024**3}
RESOLUTIONS = {"4k": (3840, 2160), "1080p": (1920, 1080), "720p": (1280, 720)}


def duration_spec(text: Column) -> Column:
    """Seconds from ``3600`` or ``1h30m20s``; zero and malformed specs are null."""
    pattern = r"^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$"
    low = F.lower(text)

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(low, pattern, group).try_cast("bigint"), F.lit(0))

    total = (
        F.when(low.rlike(r"^\d+$"), low.try_cast("bigint"))
        .when(low.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3))
    )
    return F.when(total > 0, total)


def size_spec(text: Column) -> Column:
    """Bytes from a whole number, or a number with K, M, G or B; truncated, must be positive."""
    up = F.upper(text)
    pattern = r"^(-?[\d.]+)([KMGB]?)$"
    unit = F.regexp_extract(up, pattern, 2)
    factor = F.when(unit == "K", F.lit(SIZE_FACTORS["K"]).cast("bigint"))
    for key in ("M", "G"):
        factor = factor.when(unit == key, F.lit(SIZE_FACTORS[key]).cast("bigint"))
    factor = factor.otherwise(F.lit(1).cast("bigint"))
    number = F.when(up.rlike(pattern), F.regexp_extract(up, pattern, 1)).try_cast("double")
    value = F.when(
        F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("bigint")
    ).otherwise((number * factor).try_cast("bigint"))
    return F.when(value > 0, value)


def clock_spec(text: Column) -> Column:
    """Seconds from ``HH:MM:SS(.f)``, ``MM:SS(.f)`` or ``SS(.f)``; negative is null."""
    parts = F.split(F.trim(text), ":")
    n = F.size(parts)

    def whole(i: int) -> Column:
        piece = F.trim(F.get(parts, F.lit(i)))
        return F.when(piece.rlike(r"^[+-]?\d+$"), piece.try_cast("bigint"))

    def real(i: int) -> Column:
        piece = F.trim(F.get(parts, F.lit(i)))
        return F.when(piece.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), piece.try_cast("double"))

    total = (
        F.when(n == 3, whole(0) * 3600 + whole(1) * 60 + real(2))
        .when(n == 2, whole(0) * 60 + real(1))
        .when(n == 1, real(0))
    )
    return F.when(total >= 0, total)


def frame_rate(text: Column) -> Column:
    """A fraction or a plain number as frames per second, ``0.0`` when unusable."""
    clean = F.trim(text)
    fraction = r"^([+-]?\d+)/(\d+)$"
    ratio = F.try_divide(
        F.regexp_extract(clean, fraction, 1).try_cast("double"),
        F.regexp_extract(clean, fraction, 2).try_cast("double"),
    )
    plain = F.when(
        clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), clean.try_cast("double")
    )
    return F.coalesce(F.when(clean.rlike(fraction), ratio).otherwise(plain), F.lit(0.0))


def resolution_spec(text: Column) -> Column:
    """Struct (width, height) from a preset name or ``WxH``; null when not understood."""
    low = F.lower(text)
    pattern = r"^\s*\+?(\d+)\s*x\s*\+?(\d+)\s*$"
    width = F.regexp_extract(low, pattern, 1).try_cast("bigint")
    height = F.regexp_extract(low, pattern, 2).try_cast("bigint")

    def pair(w: Column, h: Column) -> Column:
        return F.struct(w.cast("bigint").alias("width"), h.cast("bigint").alias("height"))

    out = None
    for name, (w, h) in RESOLUTIONS.items():
        cond, val = low == name, pair(F.lit(w), F.lit(h))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.when((width > 0) & (height > 0), pair(width, height))


def schedule_check(text: Column, now: Column) -> Column:
    """Struct (ok, publish_at, reason) for a planned publishing time.

    ``now`` is a parameter so that a rerun gives the same answer; times without
    a zone are taken in the session time zone.
    """
    normal = F.trim(text)
    normal = F.when(
        normal.contains(" ") & ~normal.contains("T"), F.regexp_replace(normal, r"^([^ ]*) ", "$1T")
    ).otherwise(normal)
    shape = r"^\d{4}-\d{2}-\d{2}(T\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    # hour-only times are legal ISO but not a Spark literal
    literal = F.regexp_replace(normal, r"T(\d{2})(?=$|Z|[+-])", "T$1:00")
    parsed = F.when(normal.rlike(shape), literal).try_cast("timestamp")
    late = (F.unix_micros(now) - F.unix_micros(parsed)) / F.lit(1e6)
    ago = (
        F.when(late < 3600, F.concat((late / 60).cast("bigint"), F.lit("분 전")))
        .when(late < 86400, F.concat((late / 3600).cast("bigint"), F.lit("시간 전")))
        .otherwise(F.concat((late / 86400).cast("bigint"), F.lit("일 전")))
    )
    reason = F.when(parsed.isNull(), F.lit("invalid format")).when(
        parsed < now, F.concat(F.lit("in the past: "), ago)
    )
    return F.struct(reason.isNull().alias("ok"), parsed.alias("publish_at"), reason.alias("reason"))
