"""Typed rows from raw tool output and JSON text.

Inputs are tables of (media_id, raw) or log lines; rows that cannot be read keep a
``reason`` instead of failing the job, see :func:`coverage` and :func:`quarantine`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplake.functions.labels import clock_label, file_name, file_stem, file_suffix, parent_folder, size_label, subtitle_clock
from cliplake.functions.media import is_portrait, progress_percent
from cliplake.functions.predicates import needs_device_scan
from cliplake.functions.specs import frame_rate
from cliplake.operators.ordered import group_values, number_rows, position_block
from cliplake.operators.sequences import (
    chapters,
    device_line,
    list_runs,
    number_subtitles,
    silence_pairs,
    timeline,
)
from cliplake.operators.state import CLIPS_PER_DOCUMENT, clip_item, clip_lists, in_parts, merge_records

# Layout of the probe output, tag names, patterns and maker names.
STREAMS = (
    "array<struct<codec_type:string, codec_name:string, width:int, height:int, pix_fmt:string,"
    " r_frame_rate:string, avg_frame_rate:string, duration:string, color_space:string,"
    " color_transfer:string, color_primaries:string, sample_aspect_ratio:string, sample_rate:string,"
    " channels:string, tags:map<string,string>>>"
)
PROBE = f"streams {STREAMS}, format struct<duration:string, tags:map<string,string>>"
UNSET_ASPECT = ("0:1", "0/1", "")
MAKER_NAMES = {
    "NIKON CORPORATION": "Nikon",
    "NIKON": "Nikon",
    "CANON INC.": "Canon",
    "CANON": "Canon",
    "SONY": "Sony",
    "FUJIFILM": "Fujifilm",
    "PANASONIC": "Panasonic",
    "OM DIGITAL SOLUTIONS": "OM System",
    "OLYMPUS CORPORATION": "Olympus",
    "OLYMPUS IMAGING CORP.": "Olympus",
    "APPLE": "Apple",
}
NUMBER = r"\d+(?:\.\d+)?"
ISO6709 = rf"([+-]{NUMBER})([+-]{NUMBER})"
COMPASS = rf"(?i)\b([NS])\s*({NUMBER})\s*,?\s*([EW])\s*({NUMBER})"
LATITUDE = rf"(?i)\blat(?:itude)?\s*[:=]\s*([+-]?{NUMBER})"
LONGITUDE = rf"(?i)\blon(?:gitude)?\s*[:=]\s*([+-]?{NUMBER})"
PAIR = rf"([+-]?{NUMBER})\s*[ ,;/|]\s*([+-]?{NUMBER})"
PLACE_KEYS = "location|gps|address|venue|geo"
LOUDNESS_BLOCK = r"(?s)\[Parsed_loudnorm.*?\].*?(\{.*?\})"
LOUDNESS_FIELDS = ("input_i", "input_tp", "input_lra", "input_thresh", "target_offset")
SCORE = r"([0-9.+eE-]+|inf|nan)"
VMAF_LAYOUT = (
    "metrics map<string,string>, `metrics.vmaf` string, pooled_metrics map<string,string>,"
    " frames array<struct<metrics:map<string,string>>>"
)
METRICS = ("ssim", "psnr", "vmaf")

LINES_PER_DOCUMENT = 1000


def coverage(df: DataFrame) -> DataFrame:
    """How many rows were read, and how many fell out for which reason."""
    return df.groupBy(F.coalesce("reason", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows)."""
    return df.filter("reason IS NULL"), df.filter("reason IS NOT NULL")


def _hit(text: Column, pattern: str, group: int) -> Column:
    """Group of the first match, null without a match or for an empty group."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


# ------------------------------------------------------------------ probe
def parse_probe(raw: DataFrame) -> DataFrame:
    """Probe JSON with the first video and audio stream picked out.

    The JSON leaves through a generator: a filter on anything derived from it would
    otherwise be pushed below and repeat the parsing for every mention.
    """
    parsed = raw.select("*", F.inline(F.array(F.struct(F.from_json("raw", PROBE).alias("p")))))

    def of_type(kind: str) -> Column:
        streams = F.coalesce("p.streams", F.array().cast(STREAMS))
        return F.filter(streams, lambda s: s["codec_type"] == kind)

    picked = F.struct(
        F.get(of_type("video"), F.lit(0)).alias("video"),
        F.get(of_type("audio"), F.lit(0)).alias("audio"),
        F.size(of_type("audio")).alias("audio_stream_count"),
    )
    return parsed.select("*", F.inline(F.array(picked)))


def probe_metadata(raw: DataFrame) -> DataFrame:
    """Normalised stream metadata per media, or the reason it cannot be used."""
    v, a = "video.", "audio."
    r_rate = frame_rate(F.coalesce(F.col(v + "r_frame_rate"), F.lit("0/1")))
    avg_rate = frame_rate(F.coalesce(F.col(v + "avg_frame_rate"), F.lit("0/1")))
    duration = F.coalesce(
        F.nullif(F.col(v + "duration"), F.lit("")), F.col("p.format.duration"), F.lit("0")
    ).try_cast("double")
    rotation = F.coalesce(F.element_at(v + "tags", "rotate"), F.lit("0")).try_cast("int")
    reason = (
        F.when(F.col("p.streams").isNull() & F.col("p.format").isNull(), F.lit("unreadable json"))
        .when(F.col("video").isNull(), F.lit("no video stream"))
        .when(
            F.col(v + "width").isNull() | F.col(v + "height").isNull() | F.col(v + "codec_name").isNull(),
            F.lit("incomplete video stream"),
        )
        .when(duration.isNull() | rotation.isNull(), F.lit("unreadable number"))
    )
    out = parse_probe(raw).withColumn("reason", reason)
    return out.select(
        "media_id",
        F.col(v + "width").alias("width"),
        F.col(v + "height").alias("height"),
        F.col(v + "codec_name").alias("codec"),
        F.when(F.col("video").isNotNull(), F.coalesce(F.col(v + "pix_fmt"), F.lit("unknown"))).alias("pixel_format"),
        F.when(F.col("video").isNotNull(), r_rate).alias("fps"),
        F.when(F.col("video").isNotNull(), r_rate != avg_rate).alias("is_vfr"),
        F.when(F.col("video").isNotNull(), duration).alias("duration_seconds"),
        F.when(F.col("video").isNotNull(), is_portrait(rotation, F.col(v + "width"), F.col(v + "height"))).alias("is_portrait"),
        F.col(v + "color_space").alias("color_space"),
        F.col(v + "color_transfer").alias("color_transfer"),
        F.col(v + "color_primaries").alias("color_primaries"),
        F.when(~F.col(v + "sample_aspect_ratio").isin(*UNSET_ASPECT), F.col(v + "sample_aspect_ratio")).alias("sar"),
        F.col("audio").isNotNull().alias("has_audio"),
        "audio_stream_count",
        F.col(a + "codec_name").alias("audio_codec"),
        F.col(a + "sample_rate").try_cast("int").alias("audio_sample_rate"),
        F.col(a + "channels").try_cast("int").alias("audio_channels"),
        "reason",
    )


# ------------------------------------------------------------------ device
def maker_name(make: Column) -> Column:
    """Display name of a maker; unknown ones show their first word in title case."""
    clean = F.trim(make)
    known = F.coalesce(*[F.when(F.upper(clean) == k, F.lit(n)) for k, n in MAKER_NAMES.items()])
    return F.coalesce(known, F.initcap(_hit(clean, r"^(\S+)", 1)), clean)


def maker_model(make: Column, model: Column) -> Column:
    """Maker and model as one name, without naming the maker twice."""
    clean = F.nullif(F.trim(model), F.lit(""))
    no_make = F.coalesce(make, F.lit("")) == ""
    name = maker_name(make)
    up = F.upper(clean)

    def without(prefix: Column) -> Column:
        return F.trim(clean.substr(F.length(prefix) + 1, F.length(clean)))

    raw, shown = F.upper(F.trim(make)), F.upper(name)
    rest = (
        F.when((raw != "") & up.startswith(raw), without(raw))
        .when((shown != "") & up.startswith(shown), without(shown))
        .otherwise(clean)
    )
    return (
        F.when(clean.isNull(), F.lit(None).cast("string"))
        .when(no_make & up.startswith("HERO"), F.concat(F.lit("GoPro "), clean))
        .when(no_make, clean)
        .when(rest == "", name)
        .otherwise(F.trim(F.concat(name, F.lit(" "), rest)))
    )


def device_models(raw: DataFrame) -> DataFrame:
    """Device per media from probe tags, else from the maker tags (make, model columns)."""
    parsed = parse_probe(raw)

    def tag(name: str) -> Column:
        return F.element_at("p.format.tags", name)

    apple = F.nullif(F.trim(tag("com.apple.quicktime.model")), F.lit(""))
    apple = F.trim(F.regexp_replace(F.trim(F.regexp_replace(apple, "^Apple ", "")), r"(?i)\s+\d+mm$", ""))
    firmware = _hit(tag("firmware"), r"(?i)^HD(\d+)\.", 1)
    handlers = F.filter(
        "p.streams",
        lambda s: (s["codec_type"] == "video")
        & F.coalesce(F.lower(F.element_at(s["tags"], "handler_name")).contains("gopro"), F.lit(False)),
    )
    device = F.coalesce(
        apple,
        F.when(F.upper(tag("encoder")).startswith("DJI"), F.trim(tag("encoder"))),
        F.concat(F.lit("GoPro HERO "), firmware),
        F.when(F.size(handlers) > 0, F.lit("GoPro")),
        maker_model(F.col("make"), F.col("model")),
    )
    return parsed.select("media_id", device.alias("device_model"))


# ------------------------------------------------------------------ location
def _valid(lat: Column, lon: Column) -> Column:
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def _written_pair(text: Column) -> Column:
    """Coordinates in signed or compass notation, null if absent or out of range."""
    signed = _valid(_hit(text, ISO6709, 1).cast("double"), _hit(text, ISO6709, 2).cast("double"))
    lat, lon = _hit(text, COMPASS, 2).cast("double"), _hit(text, COMPASS, 4).cast("double")
    compass = _valid(
        F.when(F.upper(_hit(text, COMPASS, 1)) == "S", -lat).otherwise(lat),
        F.when(F.upper(_hit(text, COMPASS, 3)) == "W", -lon).otherwise(lon),
    )
    return F.coalesce(signed, compass)


def _first(items: Column, value, keep=None) -> Column:
    """First non-null value over an array."""
    rows = items if keep is None else F.filter(items, keep)
    return F.get(F.filter(F.transform(rows, value), lambda x: x.isNotNull()), F.lit(0))


def _tag_pair(tags: Column) -> Column:
    entries = F.filter(
        F.transform(
            F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.trim(e["value"]).alias("v"))
        ),
        lambda e: e["v"] != "",
    )

    def axis(prefix: str, pattern: str) -> Column:
        def number(e: Column) -> Column:
            return _hit(e["v"], pattern, 1).cast("double")

        return F.coalesce(_first(entries, number, lambda e: e["k"].startswith(prefix)), _first(entries, number))

    return F.coalesce(
        _first(entries, lambda e: _written_pair(e["v"])),
        _valid(axis("lat", LATITUDE), axis("lon", LONGITUDE)),
    )


def _tag_place(tags: Column) -> Column:
    return _first(
        F.map_entries(tags),
        lambda e: F.nullif(F.trim(e["value"]), F.lit("")),
        lambda e: F.lower(e["key"]).rlike(PLACE_KEYS),
    )


def _sidecar_pair(text: Column) -> Column:
    """Coordinates in subtitle text: anywhere in it, else line by line, skipping cues."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x))
    usable = F.filter(lines, lambda x: (x != "") & ~x.contains("-->") & ~x.rlike(r"^\d+$"))

    def in_line(x: Column) -> Column:
        pair = F.struct(_hit(x, PAIR, 1).cast("double").alias("lat"), _hit(x, PAIR, 2).cast("double").alias("lon"))
        return F.coalesce(_written_pair(x), F.when(x.rlike(PAIR), pair))

    return F.coalesce(_written_pair(text), _first(usable, in_line))


def locations(raw: DataFrame) -> DataFrame:
    """Coordinates and place text per media from probe tags, else from ``sidecar`` text."""
    parsed = parse_probe(raw)
    outer, inner = F.col("p.format.tags"), F.col("video.tags")
    found = parsed.select(
        "media_id",
        F.coalesce(_tag_pair(outer), _tag_pair(inner)).alias("pair"),
        F.coalesce(_tag_place(outer), _tag_place(inner)).alias("place"),
        _sidecar_pair(F.col("sidecar")).alias("side"),
    )
    pair = F.coalesce("pair", F.when(F.col("place").isNull(), _valid(F.col("side.lat"), F.col("side.lon"))))
    located = found.select("media_id", pair.alias("c"), F.when(F.col("pair").isNull(), F.col("place")).alias("place"))
    text = F.concat(F.format_string("%.6f", "c.lat"), F.lit(", "), F.format_string("%.6f", "c.lon"))
    return located.select(
        "media_id",
        F.col("c.lat").alias("latitude"),
        F.col("c.lon").alias("longitude"),
        F.when(F.col("c").isNotNull(), text).otherwise(F.col("place")).alias("location"),
    )


# ------------------------------------------------------------------ logs
def split_lines(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Log lines (media_id, line_no, line) of whole texts."""
    return raw.select("media_id", F.posexplode(F.split(column, "\n")).alias("line_no", "line"))


def progress_points(lines: DataFrame) -> DataFrame:
    """Position, frame, speed and bitrate of every progress line."""
    clock = r"time=(\d{2}):(\d{2}):(\d{2})\.(\d{2})"
    line = F.col("line")
    h, m, s, cs = (F.regexp_extract(line, clock, g).try_cast("int") for g in (1, 2, 3, 4))
    return (
        lines.filter(line.rlike(clock))
        .select(
            "media_id",
            "line_no",
            (h * 3600 + m * 60 + s + cs / 100).alias("time_s"),
            _hit(line, r"frame=\s*(\d+)", 1).try_cast("double").alias("frame"),
            _hit(line, r"fps=\s*([\d.]+)", 1).try_cast("double").alias("fps"),
            _hit(line, r"bitrate=\s*([\d.]+)kbits/s", 1).try_cast("double").alias("bitrate"),
        )
    )


def latest_progress(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Last progress of every media, with its percent of the total length."""
    point = F.struct("time_s", "frame", "fps", "bitrate")
    last = progress_points(lines).groupBy("media_id").agg(
        F.max_by(point, "line_no").alias("p"), F.count(F.lit(1)).alias("points")
    )
    return last.join(totals, "media_id", "left").select(
        "media_id", "points", "p.*", progress_percent(F.col("p.time_s"), F.coalesce("total_s", F.lit(0.0))).alias("percent")
    )


def silence_summary(lines: DataFrame) -> DataFrame:
    """Silent spans and their total length for every media in the log."""
    spans = silence_pairs(lines).groupBy("media_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("length_s").alias("silence_s")
    )
    media = lines.groupBy("media_id").agg(F.count(F.lit(1)).alias("lines"))
    return media.join(spans, "media_id", "left").select(
        "media_id",
        "lines",
        F.coalesce("segments", F.lit(0)).alias("segments"),
        F.coalesce("silence_s", F.lit(0.0)).alias("silence_s"),
    )


def loudness_stats(raw: DataFrame) -> DataFrame:
    """Five loudness numbers per log, or why they are missing; silence is a reason of its own."""
    block = _hit(F.col("raw"), LOUDNESS_BLOCK, 1)
    values = raw.select("media_id", block.alias("block"), F.from_json(block, "map<string,string>").alias("m"))
    numbers = {f: F.element_at("m", f).try_cast("double") for f in LOUDNESS_FIELDS}
    out = values.select("media_id", "block", "m", *[v.alias(f) for f, v in numbers.items()])
    missing = F.lit(False)
    for f in LOUDNESS_FIELDS:
        missing = missing | F.col(f).isNull()

    def infinite(c: str) -> Column:
        return F.abs(F.col(c)) == F.lit(float("inf"))

    reason = (
        F.when(F.col("block").isNull(), F.lit("no loudness block"))
        .when(F.col("m").isNull(), F.lit("unreadable json"))
        .when(missing, F.lit("missing number"))
        .when(infinite("input_i") | infinite("input_tp"), F.lit("silent"))
    )
    good = out.withColumn("reason", reason)
    return good.select(
        "media_id", *[F.when(F.col("reason").isNull(), F.col(f)).alias(f) for f in LOUDNESS_FIELDS], "reason"
    )


# ------------------------------------------------------------------ quality
def _finite(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def _last_score(text: Column, label: str) -> Column:
    values = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i){label}{SCORE}"), F.lit(1)), _finite)
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1))


def _numeric_or_first(text: Column) -> Column:
    """A number, or the first number among the values of a JSON object."""
    members = F.map_values(F.from_json(text, "map<string,string>"))
    return F.coalesce(_finite(text), _first(members, _finite))


def _vmaf_member(members: Column) -> Column:
    """Score of the first key naming VMAF in a map of JSON values."""
    return _first(
        F.map_entries(members),
        lambda e: _numeric_or_first(e["value"]),
        lambda e: F.lower(e["key"]).contains("vmaf"),
    )


def _vmaf_of_lines(lines: Column) -> Column:
    """Scores of JSON log lines, for the layouts the tool writes; each line is parsed once."""
    parsed = F.transform(
        lines, lambda x: F.struct(F.from_json(x, VMAF_LAYOUT).alias("j"), x.alias("text"))
    )
    return F.transform(
        parsed,
        lambda p: F.coalesce(
            _vmaf_member(p["j"]["metrics"]),
            _numeric_or_first(p["j"]["metrics.vmaf"]),
            _vmaf_member(p["j"]["pooled_metrics"]),
            _first(p["j"]["frames"], lambda f: _vmaf_member(f["metrics"])),
            _vmaf_member(F.from_json(p["text"], "map<string,string>")),
        ),
    )


def quality_scores(raw: DataFrame) -> DataFrame:
    """SSIM, PSNR and VMAF per log: the last finite score of each."""
    text = F.col("raw")
    json_lines = F.filter(F.split(text, "\n"), lambda x: x.contains("{"))
    bodies = F.transform(json_lines, lambda x: F.trim(x.substr(F.locate("{", x), F.length(x))))
    from_json = F.filter(_vmaf_of_lines(bodies), lambda x: x.isNotNull())
    return raw.select(
        "media_id",
        _last_score(text, "All:").alias("ssim"),
        _last_score(text, "average:").alias("psnr"),
        F.coalesce(
            _last_score(text, r"VMAF.*score[:=]\s*"), F.try_element_at(from_json, F.lit(-1))
        ).alias("vmaf"),
    )


def quality_report(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores per source and output (pair_id, present, supported), with what is missing.

    ``supported`` lists the metrics that could be measured. A pair whose files are gone
    has no scores and one error.
    """
    rows = pairs.join(scores.withColumnRenamed("media_id", "pair_id"), "pair_id", "left")
    present = F.col("present")
    unavailable = F.array_compact(
        F.array(
            *[
                F.when(~present | ~F.array_contains("supported", m) | F.col(m).isNull(), F.lit(m))
                for m in METRICS
            ]
        )
    )
    failed = F.array_compact(
        F.array(
            F.when(~present, F.lit("files missing")),
            *[
                F.when(present & F.array_contains("supported", m) & F.col(m).isNull(), F.lit(f"{m}: no score"))
                for m in METRICS
            ],
        )
    )
    usable = {m: F.when(present & F.array_contains("supported", m), F.col(m)) for m in METRICS}
    return rows.select(
        "pair_id", *[v.alias(m) for m, v in usable.items()], unavailable.alias("unavailable"), failed.alias("errors")
    )


# ------------------------------------------------------------------ clip lists and documents
def flatten_clips(merges: DataFrame, clips_per_row: int = CLIPS_PER_DOCUMENT) -> DataFrame:
    """Clips listed in ``clips_info_json``, one row each; unreadable lists give none.

    A list stored in several rows carries their number in ``part``.
    """
    clip = "array<struct<name:string,duration:double,device:string,shot_time:string>>"
    offset = F.col("part") * clips_per_row if "part" in merges.columns else F.lit(0)
    rows = merges.select(
        "id", offset.alias("offset"), F.posexplode(F.from_json("clips_info_json", clip)).alias("i", "c")
    )
    return rows.select(
        F.col("id").alias("merge_id"),
        (F.col("offset") + F.col("i") + 1).alias("position"),
        F.coalesce("c.name", F.lit("-")).alias("name"),
        F.coalesce("c.duration", F.lit(0.0)).alias("duration"),
        F.coalesce("c.device", F.lit("-")).alias("device"),
        F.coalesce("c.shot_time", F.lit("-")).alias("shot_time"),
    )


def pack_lines(
    lines: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    head: Column | None = None,
    tail: Column | None = None,
    per_row: int = LINES_PER_DOCUMENT,
) -> DataFrame:
    """Lines of a document joined into rows of at most ``per_row`` lines.

    ``head`` goes before the first line and ``tail`` behind the last one. An ordinary
    document is one row (``part`` 0); the parts of a very long one, put one after the
    other, are the whole text.
    """
    key, order = list(key), list(order)
    block = F.struct(*order[:-1], position_block(order[-1]))
    rows = number_rows(lines, key, order, block, "line_no")
    line = F.col("line")
    if head is not None:
        line = F.when(F.col("line_no") == 1, F.concat(head, line)).otherwise(line)
    if tail is not None:
        rows = group_values(rows, key, __n=F.count(F.lit(1)))
        line = F.when(F.col("line_no") == F.col("__n"), F.concat(line, tail)).otherwise(line)
    part = F.floor((F.col("line_no") - 1) / per_row).cast("bigint")
    packed = rows.groupBy(*key, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("l")
    )
    return packed.select(*key, "part", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def _documents(
    lists: DataFrame, key: Sequence[str], head: Column | None = None, tail: Column | None = None, per_row: int = LINES_PER_DOCUMENT
) -> DataFrame:
    """:func:`pack_lines` of short documents, whose ``lines`` are one array already."""
    lines, last = F.col("lines"), F.size("lines")

    def ends(x: Column, i: Column) -> Column:
        x = x if head is None else F.when(i == 0, F.concat(head, x)).otherwise(x)
        return x if tail is None else F.when(i + 1 == last, F.concat(x, tail)).otherwise(x)

    full = lines if head is None and tail is None else F.transform(lines, ends)
    bodies = F.transform(in_parts(F.col("full"), per_row), lambda x: F.array_join(x, "\n"))
    cut = lists.select(*key, full.alias("full")).select(*key, F.posexplode(bodies).alias("part", "body"))
    return cut.select(*key, F.col("part").cast("bigint").alias("part"), "body")


def subtitle_lines(segments: DataFrame, kind: str = "srt") -> DataFrame:
    """Cues (media_id, number, line) of subtitle segments; blank ones are dropped."""
    mark = "," if kind == "srt" else "."
    start = F.coalesce(F.col("start_s").try_cast("double"), F.lit(0.0))
    end = F.coalesce(F.col("end_s").try_cast("double"), F.when(F.col("end_s").isNull(), start), F.lit(0.0))
    cue = F.concat(subtitle_clock(start, mark), F.lit(" --> "), subtitle_clock(end, mark), F.lit("\n"), F.trim("text"))
    numbered = number_subtitles(segments)
    line = F.concat(F.col("number").cast("string"), F.lit("\n"), cue) if kind == "srt" else cue
    return numbered.select("media_id", "number", F.concat(line, F.lit("\n")).alias("line"))


def subtitle_documents(segments: DataFrame, kind: str = "srt", cues_per_row: int = LINES_PER_DOCUMENT) -> DataFrame:
    """Whole SRT or VTT documents per media, packed as in :func:`pack_lines`."""
    cues = subtitle_lines(segments, kind)
    part = F.floor((F.col("number") - 1) / cues_per_row).cast("bigint")
    packed = cues.groupBy("media_id", part.alias("part")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n"
        ).alias("body")
    )
    if kind != "vtt":
        return packed
    head = F.when(F.col("part") == 0, F.lit("WEBVTT\n\n")).otherwise(F.lit(""))
    return packed.withColumn("body", F.concat(head, "body"))


CLIP_HEAD = "\n".join(
    ("## 클립 정보", "", "| # | 파일명 | 기종 | 촬영시간 | 길이 |", "|---|--------|------|----------|------|", "")
)
CHAPTER_HEAD = "\n".join(("", "## YouTube 챕터", "", "```", ""))
CHAPTER_TAIL = "\n```"
DEVICE_LINE = ("\n\n이 영상은 ", "로 촬영됨")


def _chapter_lines(clips: DataFrame) -> DataFrame:
    return chapters(clips, ["merge_id"]).select(
        "merge_id", F.lit(1).alias("block"), F.col("run").alias("pos"), F.concat("clock", F.lit(" "), "title").alias("line")
    )


def _device_tail() -> Column:
    return F.when(F.col("devices").isNull(), F.lit("")).otherwise(
        F.concat(F.lit(DEVICE_LINE[0]), "devices", F.lit(DEVICE_LINE[1]))
    )


def _table_row() -> Column:
    def shown(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))

    return F.concat_ws(
        " | ",
        F.concat(F.lit("| "), "position"),
        F.col("name"),
        shown("device"),
        shown("shot_time"),
        F.concat(clock_label(F.col("duration"), half_even=True), F.lit(" |")),
    )


def _lines_of(listed: str, field: str = "line") -> Column:
    return F.transform(listed, lambda x: x[field])


def _run_rows(clips: DataFrame) -> DataFrame:
    """Clips of short lists with the line of their chapter where a run begins."""
    rows = list_runs(clips, ["merge_id"], short=True)
    before = F.lag("run").over(Window.partitionBy("merge_id").orderBy("position"))
    start = clock_label(F.coalesce("__before", F.lit(0.0)), half_even=True)
    rows = rows.withColumn("opens", F.coalesce(before != F.col("run"), F.lit(True)))
    return rows.withColumn("chapter", F.concat(start, F.lit(" "), file_stem(F.col("name"))))


def _chapter_list() -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("opens"), F.struct("run", F.col("chapter").alias("line")))))


def _device_list() -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("device") != "", F.struct("position", "device"))))


def _device_text() -> Column:
    """Of the column ``devices``, as :func:`device_line` writes it."""
    names = F.array_distinct(_lines_of("devices", "device"))
    return F.when(F.size(names) > 0, F.array_join(names, ", "))


def clip_summaries(clips: DataFrame, short: bool = False) -> DataFrame:
    """Clip table and chapter list of every merge as a document."""
    if short:
        table = F.struct("position", _table_row().alias("line"))
        lists = _run_rows(clips).groupBy("merge_id").agg(
            F.array_sort(F.collect_list(table)).alias("rows"), _chapter_list().alias("chapters")
        )
        lines = F.concat(_lines_of("rows"), _lines_of("chapters"))
        first = F.size("rows") + 1
        lines = F.transform(lines, lambda x, i: F.when(i + 1 == first, F.concat(F.lit(CHAPTER_HEAD), x)).otherwise(x))
        return _documents(lists.select("merge_id", lines.alias("lines")), ["merge_id"], F.lit(CLIP_HEAD), F.lit(CHAPTER_TAIL))
    table = clips.select("merge_id", F.lit(0).alias("block"), F.col("position").alias("pos"), _table_row().alias("line"))
    listed = _chapter_lines(clips).withColumn(
        "line", F.when(F.col("pos") == 1, F.concat(F.lit(CHAPTER_HEAD), "line")).otherwise(F.col("line"))
    )
    return pack_lines(
        table.unionByName(listed),
        ["merge_id"],
        ["block", "pos"],
        head=F.lit(CLIP_HEAD),
        tail=F.lit(CHAPTER_TAIL),
    )


def descriptions(clips: DataFrame, short: bool = False) -> DataFrame:
    """Chapter list of every merge, followed by the line naming its devices."""
    if short:
        lists = _run_rows(clips).groupBy("merge_id").agg(_chapter_list().alias("chapters"), _device_list().alias("devices"))
        lists = lists.select("merge_id", _lines_of("chapters").alias("lines"), _device_text().alias("devices"))
        return _documents(lists, ["merge_id"], None, _device_tail())
    lines = _chapter_lines(clips).join(device_line(clips, ["merge_id"]), "merge_id", "left")
    return pack_lines(lines, ["merge_id"], ["block", "pos"], tail=_device_tail())


# Headings and phrases of the summary document.
SUMMARY_LABELS = {"date": "**촬영일**: ", "length": "**총 길이**: ", "size": "**파일 크기**: ", "name": "**파일명**: "}
SUMMARY_CHAPTERS = ("", "## YouTube 챕터", "", "```")
SUMMARY_CLIPS = ("```", "", "## 클립 목록", "", "| # | 클립명 | 길이 | 시작 시간 |", "|---|--------|------|-----------|")
SUMMARY_TEMPLATE = ("", "## YouTube 설명 템플릿", "", "```")
SUMMARY_SENTENCE = ("에 촬영한 ", " 영상입니다.")
SUMMARY_PLACES = ("", "📍 장소: ", "📷 장비: ", "", "⏱️ 타임라인")
SUMMARY_END = ("", "#vlog #여행 #일상", "```")


def summary_documents(outputs: DataFrame, clips: DataFrame, short: bool = False) -> DataFrame:
    """The summary of every output (merge_id, title, date, size_bytes, output_path) as a document.

    Title, date (unless there is none), length, size and name; chapters, one per clip; the
    table of clips; a template of a description with the chapters once more. Outputs
    without clips have empty lists. Documents are packed as in :func:`pack_lines`.
    """
    start, name = clock_label(F.col("start_s"), half_even=True), file_stem(F.col("name"))
    chapter = F.concat(start, F.lit(" "), name)
    row = F.concat_ws(" | ", F.concat(F.lit("| "), "position"), name, clock_label(F.col("duration"), half_even=True), F.concat(start, F.lit(" |")))
    laid = timeline(clips, ["merge_id"], short=short)
    sums = (laid if short else clips).groupBy("merge_id").agg(
        F.sum("duration").alias("length"),
        *([F.array_sort(F.collect_list(F.struct("position", chapter.alias("chapter"), row.alias("row")))).alias("clips")] if short else []),
    )
    known = outputs.select("merge_id", "title", F.nullif("date", F.lit("")).alias("date"), "size_bytes", "output_path")
    known = known.join(sums, "merge_id", "left")  # with ``short`` the lines of the clips come along
    label = {k: F.lit(v) for k, v in SUMMARY_LABELS.items()}
    fixed = lambda texts: [F.lit(t) for t in texts]
    about, ending = (F.lit(t) for t in SUMMARY_SENTENCE)
    head = [
        F.concat(F.lit("# "), "title"), F.lit(""),
        F.concat(label["date"], "date"),
        F.concat(label["length"], clock_label(F.coalesce("length", F.lit(0.0)), half_even=True)),
        F.concat(label["size"], size_label(F.col("size_bytes"))),
        F.concat(label["name"], file_name(F.col("output_path"))),
        *fixed(SUMMARY_CHAPTERS),
    ]
    sentence = F.coalesce(F.concat("date", about, "title", ending), F.concat("title", ending))
    blocks = {0: head, 2: fixed(SUMMARY_CLIPS), 4: [*fixed(SUMMARY_TEMPLATE), sentence, *fixed(SUMMARY_PLACES)], 6: fixed(SUMMARY_END)}
    if short:
        none = F.array().cast("array<string>")
        lists = {b: F.coalesce(_lines_of("clips", kind), none) for b, kind in ((1, "chapter"), (3, "row"), (5, "chapter"))}
        laid_out = [lists[b] if b in lists else F.array_compact(F.array(*blocks[b])) for b in range(7)]
        return _documents(known.select("merge_id", F.concat(*laid_out).alias("lines")), ["merge_id"])
    frame = [
        known.select("merge_id", F.lit(block).alias("block"), F.posexplode(F.array_compact(F.array(*texts))).alias("pos", "line"))
        for block, texts in blocks.items()
    ]
    laid = laid.join(known.select("merge_id"), "merge_id", "left_semi")
    kinds = F.array(*[F.struct(F.lit(b).alias("block"), line.alias("line")) for b, line in ((1, chapter), (3, row), (5, chapter))])
    listed = laid.select("merge_id", "position", F.inline(kinds)).select("merge_id", "block", F.col("position").alias("pos"), "line")
    lines = listed
    for part in frame:
        lines = lines.unionByName(part.withColumn("pos", F.col("pos").cast("bigint")))
    return pack_lines(lines, ["merge_id"], ["block", "pos"])


def merge_jobs(outputs: DataFrame, clips: DataFrame, short: bool = False) -> DataFrame:
    """Rows to be stored for finished merges (merge_id, output_path, target, size_bytes, date).

    The title is the folder of the first target (itself, if it is no file), or the stem of
    the output where that has no name; a size that is not known is 0. Lists and the
    description come in parts as in :func:`merge_records`, all else stands in every part.
    """
    target = F.col("target")
    folder = F.when(file_suffix(target) != "", parent_folder(target)).otherwise(file_name(target))
    named = F.coalesce(F.when(~folder.isin("", "."), folder), file_stem(F.col("output_path")))
    title = F.when(target.isNotNull(), named)
    about = outputs.select("merge_id", "output_path", title.alias("title"), "date", F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("total_size_bytes"))
    if short:
        stored = _short_merges(clips).join(about, "merge_id")
    else:
        texts = descriptions(clips).withColumnRenamed("body", "summary_markdown")
        stored = merge_records(clips).join(about, "merge_id").join(texts, ["merge_id", "part"], "left")
    return stored.select(
        "merge_id", "part", "output_path", "video_ids", "title", "date",
        F.col("total_duration").alias("total_duration_seconds"), "total_size_bytes", "clips_info_json",
        F.coalesce("summary_markdown", F.lit("")).alias("summary_markdown"),
    )


def _short_merges(clips: DataFrame) -> DataFrame:
    """Records and descriptions of short merges from one pass over their clips."""
    start = F.coalesce("__before", F.lit(0.0))
    rows = _run_rows(clips).withColumns({"start_s": start, "end_s": start + F.col("duration")})
    lists = rows.groupBy("merge_id").agg(
        F.sum("duration").alias("total_duration"), F.array_sort(F.collect_list(clip_item())).alias("items"),
        _chapter_list().alias("chapters"), _device_list().alias("devices"),
    )
    lines = lists.select("*", _lines_of("chapters").alias("lines"), _device_text().alias("text")).drop("devices").withColumnRenamed("text", "devices")
    tail, last = _device_tail(), F.size("lines")
    full = F.transform("lines", lambda x, i: F.when(i + 1 == last, F.concat(x, tail)).otherwise(x))
    cut = lines.select("merge_id", "total_duration", full.alias("full"), F.posexplode(in_parts(F.col("items"), CLIPS_PER_DOCUMENT)).alias("part", "items"))
    text = F.array_join(F.slice("full", F.col("part") * LINES_PER_DOCUMENT + 1, F.lit(LINES_PER_DOCUMENT)), "\n")
    return cut.select("merge_id", F.col("part").cast("bigint").alias("part"), "total_duration", *clip_lists("items"), text.alias("summary_markdown"))


def part_descriptions(parts: DataFrame, clips: DataFrame, short: bool = False) -> DataFrame:
    """Description per split part, from its chapters (merge_id, part_no, run, clock, title)."""
    lines = parts.select("merge_id", "part_no", "run", F.concat("clock", F.lit(" "), "title").alias("line"))
    if short:
        lists = lines.groupBy("merge_id", "part_no").agg(F.array_sort(F.collect_list(F.struct("run", "line"))).alias("l"))
        named = lists.join(device_line(clips, ["merge_id"]), "merge_id", "left")
        return _documents(named.withColumn("lines", _lines_of("l")), ["merge_id", "part_no"], None, _device_tail())
    lines = lines.join(device_line(clips, ["merge_id"]), "merge_id", "left")
    return pack_lines(lines, ["merge_id", "part_no"], ["run"], tail=_device_tail())


def single_description(device: Column, shot_time: Column) -> Column:
    """Two optional lines for a video made of one clip."""
    return F.array_join(
        F.array_compact(
            F.array(
                F.when((F.coalesce(device, F.lit("")) != "") & (device != "Unknown"), F.concat(F.lit("Filmed with "), device)),
                F.when(F.coalesce(shot_time, F.lit("")) != "", F.concat(F.lit("Shot at "), shot_time)),
            )
        ),
        "\n",
    )


# ------------------------------------------------------------------ back-fill
def backfill_devices(videos: DataFrame, detected: DataFrame) -> DataFrame:
    """Fill in devices of videos that need a rescan (detected: media_id, device_model)."""
    found = detected.select(F.col("media_id").alias("id"), F.col("device_model").alias("__new"), F.lit(True).alias("__seen"))
    needs = needs_device_scan(F.col("device_model"), heuristic=True)
    outcome = (
        F.when(~needs, F.lit("not needed"))
        .when(F.col("__seen").isNull(), F.lit("missing"))
        .when(F.col("__new").isNull(), F.lit("undetected"))
        .otherwise(F.lit("updated"))
    )
    rows = videos.join(found, "id", "left").withColumn("outcome", outcome)
    return rows.withColumn(
        "device_model", F.when(F.col("outcome") == "updated", F.col("__new")).otherwise(F.col("device_model"))
    ).drop("__new", "__seen")
