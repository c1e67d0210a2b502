"""Keyword rules and scored nearest matches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplake.functions.labels import file_suffix
from cliplake.functions.predicates import AUDIO_EXTENSIONS
from cliplake.operators.ordered import micros, number_rows, scan
from cliplake.session import cut_lineage

# White-balance presets in kelvin, default keywords, score weights.
KELVIN_PRESETS = {
    "tungsten": 3200,
    "fluorescent": 4000,
    "daylight": 5500,
    "cloudy": 6500,
    "shade": 7500,
}
DEVICE_PRESETS = {
    "nikon": "daylight",
    "canon": "daylight",
    "sony": "daylight",
    "iphone": "daylight",
    "gopro": "cloudy",
    "dji": "cloudy",
}
LENGTH_WEIGHT = 0.65
TIME_WEIGHT = 0.35
MATCH_WINDOW_SECONDS = 300.0
MIN_SCORE = 0.2

TILE = 32  # recordings that are looked at together


def keyword_value(device: Column, rules: Mapping[str, str]) -> Column:
    """Value of the longest rule keyword found in the device name, case ignored.

    Rules typed into a configuration become one conditional expression; equally
    long keywords keep their order.
    """
    ranked = sorted((k for k in rules if k), key=lambda k: -len(k))
    low = F.lower(device)
    hits = [F.when(low.contains(k.lower()), F.lit(rules[k])) for k in ranked]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def white_balance(device: Column, rules: Mapping[str, str] | None = None) -> Column:
    """Kelvin of the preset chosen for a device, null for none or an unknown preset."""
    preset = keyword_value(device, DEVICE_PRESETS if rules is None else rules)
    out = F.lit(None).cast("int")
    for name, kelvin in KELVIN_PRESETS.items():
        out = F.when(preset == name, F.lit(kelvin)).otherwise(out)
    return out


def match_rule_table(videos: DataFrame, rules: DataFrame) -> DataFrame:
    """Longest-keyword match against a rule table (keyword, value, rule_order) of any size.

    Every distinct device name is cut into its substrings, which meet the keywords in
    an equi-join; nothing is compared with every rule.
    """
    wanted = rules.filter("keyword <> ''").select(
        F.lower("keyword").alias("piece"), F.length("keyword").alias("len"), "value", "rule_order"
    )
    names = videos.select("device_model").filter("device_model <> ''").distinct()
    cuts = F.expr(
        "explode(flatten(transform(sequence(1, length(device_model)), i ->"
        " transform(sequence(1, length(device_model) - i + 1), n -> substring(lower(device_model), i, n)))))"
    )
    pieces = names.select("device_model", cuts.alias("piece")).distinct()
    best = (
        pieces.join(wanted, "piece")
        .groupBy("device_model")
        .agg(F.min_by("value", F.struct(-F.col("len"), "rule_order")).alias("value"))
    )
    return videos.join(best, "device_model", "left")


def match_score(video_len: Column, len_gap: Column, time_gap: Column, window: float) -> Column:
    by_length = F.greatest(F.lit(0.0), 1.0 - len_gap / video_len)
    by_time = F.greatest(F.lit(0.0), 1.0 - time_gap / F.lit(window))
    return by_length * F.lit(LENGTH_WEIGHT) + by_time * F.lit(TIME_WEIGHT)


def _gaps() -> tuple[Column, Column]:
    return F.abs(F.col("c_len") - F.col("v_len")), F.abs(F.col("c_us") - F.col("v_us")) / F.lit(1e6)


def _best_of(found: str, window: float) -> Column:
    """Best score among an array of (c_len, c_us) for the row's video."""

    def score(x: Column) -> Column:
        return match_score(F.col("length"), F.abs(x["c_len"] - F.col("length")), F.abs(x["c_us"] - F.col("us")) / F.lit(1e6), window)

    return F.array_max(F.transform(found, score))


def _cell(window: float) -> Column:
    """Number of the stretch of time, as long as the window, that ``us`` lies in."""
    return F.floor(F.col("us") / F.lit(window * 1e6)).cast("bigint")


def _tiles(sound: DataFrame, window: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recordings of a folder and cell of time in strips along time, cut into tiles along length:
    the tiles with their points, the boxes of the tiles of every strip, and those of the strips
    of every cell.

    A cell of n recordings has about as many strips as a strip has tiles, the root of
    n / ``TILE``, and so long is the longest list. A folder that covers more time has more cells,
    not longer lists.
    """
    cell = ["folder", "cell"]
    sound = sound.withColumn("cell", _cell(window))
    counts = sound.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    ranked = number_rows(sound, cell, ["us", "length"], None, "r").join(counts, cell)
    per_strip = F.ceil(F.sqrt(F.col("n") / F.lit(float(TILE)))) * TILE
    strips = ranked.withColumn("strip", F.floor((F.col("r") - 1) / per_strip).cast("bigint")).drop("r", "n")
    placed = number_rows(strips, [*cell, "strip"], ["length", "us"], None, "r")
    # the index is stored, as six joins read it
    placed = cut_lineage(placed.withColumn("tile", F.floor((F.col("r") - 1) / TILE).cast("bigint")))
    box = [f(c).alias(f"{n}_{c}") for c in ("us", "length") for n, f in (("lo", F.min), ("hi", F.max))]
    tiles = placed.groupBy(*cell, "strip", "tile").agg(F.collect_list(F.struct("length", "us", "path")).alias("points"), *box)
    boxed = placed.groupBy(*cell, "strip", "tile").agg(*box)
    whole = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("us", "length") for n, f in (("lo", F.min), ("hi", F.max))]
    area = ["lo_us", "hi_us", "lo_length", "hi_length"]
    by_strip = boxed.groupBy(*cell, "strip").agg(F.collect_list(F.struct("tile", *area)).alias("boxes"), *whole)
    by_cell = by_strip.groupBy(*cell).agg(F.collect_list(F.struct("strip", *area)).alias("boxes"))
    return tiles.select(*cell, "strip", "tile", "points"), by_strip.select(*cell, "strip", "boxes"), by_cell


def _candidates(asking: DataFrame, tiles: tuple[DataFrame, DataFrame, DataFrame], window: float, nearest: bool) -> DataFrame:
    """``(id, v_len, v_us, c_len, c_us, path)``: the best point of every tile that a video looks at.

    With ``nearest`` that is, in each of the three cells around the video, the strip and tile whose
    box has the best bound, else all whose
    bound reaches ``least`` inside the window.
    """
    points, by_strip, by_cell = tiles
    zero = F.lit(0.0)

    def bound(b: Column) -> Column:
        time = F.greatest(b["lo_us"] - F.col("us"), F.col("us") - b["hi_us"], F.lit(0).cast("bigint")) / F.lit(1e6)
        gap = F.greatest(b["lo_length"] - F.col("length"), F.col("length") - b["hi_length"], zero)
        return F.when(time < window, match_score(F.col("length"), gap, time, window)).otherwise(F.lit(-1.0))

    def chosen(kind: str) -> Column:
        if nearest:
            rated = F.transform("boxes", lambda b: F.struct(bound(b).alias("s"), b[kind].alias(kind)))
            best = F.array_max(rated)
            return F.when(best["s"] > 0, F.array(best[kind]))
        # a little below, as bounds and scores are rounded apart
        return F.transform(F.filter("boxes", lambda b: bound(b) >= F.col("least") - 1e-12), lambda b: b[kind])

    cell, v = ["folder", "cell"], ["id", "folder", "cell", "length", "us", "least"]
    # small rows with much work each: kept on all tasks
    n = int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = F.explode(F.sequence(_cell(window) - 1, _cell(window) + 1)).alias("cell")
    in_cell = asking.select("id", "folder", "length", "us", "least", around).repartition(n, *cell)
    in_strip = in_cell.join(by_cell, cell).select(*v, F.explode(chosen("strip")).alias("strip"))
    in_tile = in_strip.join(by_strip, [*cell, "strip"]).select(*v, "strip", F.explode(chosen("tile")).alias("tile"))
    met = in_tile.repartition(n, *cell, "strip", "tile").join(points, [*cell, "strip", "tile"])

    def rated(p: Column) -> Column:
        score = match_score(F.col("length"), F.abs(p["length"] - F.col("length")), F.abs(p["us"] - F.col("us")) / F.lit(1e6), window)
        return F.struct((-score).alias("s"), p["path"].alias("path"), p["length"].alias("length"), p["us"].alias("us"))

    top = F.array_min(F.transform("points", rated))
    return met.select("id", F.col("length").alias("v_len"), F.col("us").alias("v_us"), top.alias("p")).select(
        "id", "v_len", "v_us", F.col("p.length").alias("c_len"), F.col("p.us").alias("c_us"), F.col("p.path").alias("path")
    )


def match_recordings(
    videos: DataFrame,
    recordings: DataFrame,
    window: float = MATCH_WINDOW_SECONDS,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Best recording (folder, path, at, length) for every video (id, folder, at, length).

    The score adds closeness in length and in time. A recording outside the time
    window scores on length alone, so among those only the two neighbours in length
    can win: they come from ordered scans. For recordings inside the window the search
    branches and bounds: only cells of time next to a video can hold one; in them recordings
    lie in tiles of some dozen neighbours in time and length, a tile's box tells the best
    score it could hold, and what a video has already found rules tiles out. The tile next to a video is looked at first, then those that may
    still hold a better one, or one as good with an earlier path. The result is the exact
    optimum; ties go to the first path.
    """
    if min_score <= 0 or window <= 0:
        raise ValueError("min_score and window must be positive")
    sound = recordings.filter(
        F.lower(file_suffix(F.col("path"))).isin(*AUDIO_EXTENSIONS) & (F.col("length") > 0)
    ).select("folder", "path", "length", micros(F.col("at")).alias("us"))
    sound = sound.groupBy("folder", "length", "us").agg(F.min("path").alias("path"))
    asked = videos.select("id", "folder", "length", micros(F.col("at")).alias("us"))
    usable = asked.filter("length > 0")

    # neighbours in length
    lengths = sound.groupBy("folder", "length").agg(F.min_by(F.struct("path", "us"), "path").alias("rec"))
    mixed = lengths.select("folder", "length", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("id"), "rec").unionByName(
        usable.select("folder", "length", F.lit(1).alias("kind"), "id"), allowMissingColumns=True
    )
    mixed = mixed.withColumn("down", -F.col("length"))
    is_rec = F.col("kind") == 0
    value = F.struct("length", "rec")
    below = scan(
        mixed,
        ["folder"],
        ["length", "kind", "id"],
        F.floor(F.col("length") / 10).cast("bigint"),
        near=("last", F.when(is_rec, F.struct(F.col("length").alias("k"), value.alias("v")))),
    )
    above = scan(
        mixed,
        ["folder"],
        ["down", "kind", "id"],
        F.floor(F.col("down") / 10).cast("bigint"),
        near=("last", F.when(is_rec, F.struct(F.col("down").alias("k"), value.alias("v")))),
    )
    by_length = (
        below.unionByName(above)
        .filter("kind = 1 AND near IS NOT NULL")
        .select("id", F.col("near.v.length").alias("c_len"), F.col("near.v.rec.path").alias("path"), F.col("near.v.rec.us").alias("c_us"))
    )

    # inside the time window: tiles of recordings that can still beat what is known
    known = by_length.groupBy("id").agg(F.collect_list(F.struct("c_len", "c_us")).alias("found"))  # two at most
    asking = cut_lineage(usable.join(known, "id").withColumn("least", _best_of("found", window)))
    tiles = _tiles(sound, window)
    first = _candidates(asking, tiles, window, nearest=True)
    better = first.groupBy("id").agg(F.max(match_score(F.col("v_len"), *_gaps(), window)).alias("__score"))
    asking = asking.join(better, "id", "left").withColumn("least", F.greatest("least", "__score")).drop("__score")
    near_time = _candidates(asking, tiles, window, nearest=False).select("id", "c_len", "path", "c_us")
    pairs = by_length.unionByName(near_time).join(
        usable.select("id", F.col("length").alias("v_len"), F.col("us").alias("v_us")), "id"
    )
    len_gap = F.abs(F.col("c_len") - F.col("v_len"))
    time_gap = F.abs(F.col("c_us") - F.col("v_us")) / F.lit(1e6)
    scored = pairs.select(
        "id",
        "path",
        len_gap.alias("length_gap"),
        time_gap.alias("time_gap"),
        match_score(F.col("v_len"), len_gap, time_gap, window).alias("score"),
    )
    best = scored.groupBy("id").agg(
        F.min_by(
            F.struct("path", "score", "length_gap", "time_gap"), F.struct(-F.col("score"), "path")
        ).alias("b")
    )
    good = F.col("b.score") >= min_score
    reason = (
        F.when(~F.coalesce(F.col("length") > 0, F.lit(False)), F.lit("video length unknown"))
        .when(F.col("b").isNull(), F.lit("no recordings in folder"))
        .when(~good, F.lit("score too low"))
    )
    return asked.join(best, "id", "left").select(
        "id",
        F.when(good, F.col("b.path")).alias("recording"),
        F.col("b.score").alias("score"),
        F.when(good, F.col("b.length_gap")).alias("length_gap"),
        F.when(good, F.col("b.time_gap")).alias("time_gap"),
        reason.alias("reason"),
    )
