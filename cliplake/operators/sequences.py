"""Timelines, recording sessions, chapters and positions in ordered lists.

All running computations go through :mod:`cliplake.operators.ordered`, so a batch
or merge of any size is spread over many tasks; what runs along one order is one pass.
With ``short`` the caller states that lists are short: plain windows per list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplake.functions.labels import clock_label, file_stem
from cliplake.operators.ordered import (
    WHOLE,
    fused,
    group_values,
    micros,
    number_rows,
    position_block,
    previous_row,
    scan,
    seconds_between,
)
from cliplake.session import cut_lineage

# File-name patterns and session rules of the cameras.
CHAPTER_PATTERNS = (
    r"(?i)^GH(\d{2})(\d{4})\.\w+$",
    r"(?i)^GOPR(\d{4})\.\w+$",
    r"(?i)^GP(\d{2})(\d{4})\.\w+$",
)
SEQUENCE_PATTERN = r"(?i)^DJI_(\d{14})_(\d{4})_\w\.\w+$"
SPLIT_SIZES = (4 * 1024**3, 16 * 1024**3)
SPLIT_TOLERANCE = 0.05
MAX_GAP_SECONDS = 3 * 60 * 60


# ------------------------------------------------------------------ timelines
def timeline(
    df: DataFrame,
    keys: Sequence[str],
    position: str = "position",
    length: str = "duration",
    short: bool = False,
) -> DataFrame:
    """Add ``start_s`` and ``end_s``: lengths laid end to end in list order."""
    out = scan(df, keys, [position], WHOLE if short else position_block(position), start_s=("sum", F.col(length)))
    start = F.coalesce("start_s", F.lit(0.0))
    return out.withColumn("end_s", start + F.col(length)).withColumn("start_s", start)


def list_runs(clips: DataFrame, keys: Sequence[str], group: str = "grp", short: bool = False) -> DataFrame:
    """Clips with ``run``, its number, and ``__before``, the seconds before the clip, from one pass."""
    starts = ~F.coalesce(F.col(f"__prev.{group}") == F.col(group), F.lit(False))
    return fused(
        clips,
        keys,
        ["position"],
        WHOLE if short else position_block(),
        previous=[group],
        name="__prev",
        uses=[group, "duration"],
        run=("sum", starts.cast("bigint")),
        __before=("sum_before", F.col("duration")),
    )


def merge_runs(clips: DataFrame, keys: Sequence[str], group: str = "grp", short: bool = False) -> DataFrame:
    """Collapse consecutive clips of one group; clips without a group stand alone.

    A group that comes back later starts a new run. One row per run, numbered from 1.
    """
    return list_runs(clips, keys, group, short).groupBy(*keys, "run").agg(
        F.min_by("name", "position").alias("name"),
        F.sum("duration").alias("duration"),
        F.count(F.lit(1)).alias("clip_count"),
    )


def timed_runs(clips: DataFrame, keys: Sequence[str], group: str = "grp", short: bool = False) -> DataFrame:
    """Runs (run, name) with ``start_s`` and ``end_s``: lengths laid end to end."""
    before = F.coalesce("__before", F.lit(0.0))
    return list_runs(clips, keys, group, short).groupBy(*keys, "run").agg(
        F.min_by("name", "position").alias("name"),
        F.min_by(before, "position").alias("start_s"),
        F.max_by(before + F.col("duration"), "position").alias("end_s"),
    )


def chapters(clips: DataFrame, keys: Sequence[str], group: str = "grp", short: bool = False) -> DataFrame:
    """Start offset, clock label and title of every run."""
    return timed_runs(clips, keys, group, short).select(
        *keys,
        "run",
        "start_s",
        "end_s",
        clock_label(F.col("start_s"), half_even=True).alias("clock"),
        file_stem(F.col("name")).alias("title"),
    )


def split_parts(parts: DataFrame, title: Column, short: bool = False) -> DataFrame:
    """Boundaries and titles of the parts (merge_id, part_no, length) of a split."""
    laid = timeline(parts, ["merge_id"], "part_no", "length", short)
    laid = group_values(laid, ["merge_id"], parts=F.count(F.lit(1)))
    return laid.withColumn(
        "title", F.concat(title, F.lit(" (Part "), "part_no", F.lit("/"), "parts", F.lit(")"))
    )


def overlap_parts(
    clips: DataFrame, parts: DataFrame, seconds_per_block: float = 600.0, short: bool = False
) -> DataFrame:
    """Clips (merge_id, run, name, start_s, end_s) that share time with parts (merge_id, part_no, ...).

    Parts follow each other without gaps, so the parts a clip touches are a range of
    part numbers: the first one that ends after the clip starts up to the last one that
    starts before the clip ends. Both ends come from one running count over all
    boundaries in time order; no clip is ever compared with all parts. The first part of
    the range began where the last finished part ended; later parts begin inside the clip.
    """

    def edges(df: DataFrame, number: str, kinds: tuple[int, int], name: Column) -> DataFrame:
        marks = [
            F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"))
            for at, kind in zip(("start_s", "end_s"), kinds)
        ]
        return df.select(
            "merge_id", F.col(number).alias("no"), name.alias("name"), F.inline(F.array(*marks))
        )

    # at one instant: part ends (0), clip starts (1), clip ends (2), part starts (3)
    both = edges(clips, "run", (1, 2), F.col("name")).unionByName(
        edges(parts, "part_no", (3, 0), F.lit(None).cast("string"))
    )
    kind = F.col("kind")
    counted = scan(
        both,
        ["merge_id"],
        ["at", "kind", "no"],
        WHOLE if short else F.floor(F.col("at") / F.lit(seconds_per_block)).cast("bigint"),
        ended=("sum", (kind == 0).cast("bigint")),
        begun=("sum", (kind == 3).cast("bigint")),
        edge=("last", F.when(kind == 0, F.col("at"))),
    )
    span = (
        counted.filter(kind.isin(1, 2))
        .groupBy("merge_id", F.col("no").alias("run"))
        .agg(
            F.max("name").alias("name"),
            F.max(F.when(kind == 1, F.col("at"))).alias("start_s"),
            F.coalesce(F.max(F.when(kind == 1, F.col("ended"))), F.lit(0)).alias("before"),
            F.coalesce(F.max(F.when(kind == 1, F.col("edge"))), F.lit(0.0)).alias("edge"),
            F.coalesce(F.max(F.when(kind == 2, F.col("begun"))), F.lit(0)).alias("last"),
        )
        .filter("last > before")
    )
    return span.select("*", F.explode(F.expr("sequence(before + 1, last)")).alias("part_no")).select(
        "merge_id",
        "run",
        "part_no",
        "name",
        F.when(F.col("part_no") == F.col("before") + 1, F.col("start_s") - F.col("edge"))
        .otherwise(F.lit(0.0))
        .alias("relative_s"),
    )


# ------------------------------------------------------------------ sessions
def session_family(name: Column) -> Column:
    """``dji`` for sequence-numbered files, ``gopro_<session>`` for chaptered ones, else ``s``."""
    numbered, first, further = CHAPTER_PATTERNS
    session = (
        F.when(name.rlike(numbered), F.regexp_extract(name, numbered, 2))
        .when(name.rlike(first), F.regexp_extract(name, first, 1))
        .when(name.rlike(further), F.regexp_extract(name, further, 2))
    )
    return F.when(name.rlike(SEQUENCE_PATTERN), F.lit("dji")).otherwise(
        F.coalesce(F.concat(F.lit("gopro_"), session), F.lit("s"))
    )


def sessions(files: DataFrame, grouping: bool = True) -> DataFrame:
    """Every file of a batch with its session (``group_id``) and place in it (``member``).

    Chaptered files of one recording form a session in chapter order. Sequence-numbered
    files form islands: a file continues the previous one if its number follows, the
    previous size lies near a card split size, and the clock gap is 0 to 3 hours
    (unknown clocks fit). Other files are sessions of their own, ``s_1``, ``s_2``... in
    input order; without grouping all are, from ``s_0``.

    The three kinds differ only in what they are sorted by, so one partitioning and
    one sort serve all of them.
    """
    if not grouping:
        return files.withColumn("group_id", F.concat(F.lit("s_"), "idx")).withColumn(
            "member", F.lit(1).cast("bigint")
        )
    rows = files.withColumn("__family", session_family(F.col("name")))
    dji, single = F.col("__family") == "dji", F.col("__family") == "s"
    stamp = F.when(dji, F.regexp_extract("name", SEQUENCE_PATTERN, 1))
    number = F.when(dji, F.regexp_extract("name", SEQUENCE_PATTERN, 2)).when(
        ~single, F.regexp_extract("name", r"(?i)^G[HP](\d{2})\d{4}\.", 1)
    )
    rows = rows.withColumns(
        {
            "__clock": F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")),
            "__seq": F.coalesce(number.try_cast("int"), F.lit(0)),
        }
    )
    at = F.when(dji, micros(F.coalesce("__clock", F.col("creation_time").cast("timestamp")))).otherwise(F.lit(0))
    rows = rows.withColumn("__at", at)
    near = F.lit(False)
    for size in SPLIT_SIZES:
        near = near | (F.abs(F.col("__prev.size_bytes") - F.lit(size)) <= size * SPLIT_TOLERANCE)
    gap = seconds_between(F.col("__prev.__clock"), F.col("__clock"))
    follows = (
        (F.col("__seq") == F.col("__prev.__seq") + 1)
        & near
        & F.coalesce(gap.between(0, MAX_GAP_SECONDS), F.lit(True))
    )
    starts = F.col("__prev").isNull() | (dji & ~follows)
    rows = fused(
        rows,
        ["batch", "__family"],
        ["__at", "__seq", "idx"],
        previous=["__seq", "__clock", "size_bytes"],
        name="__prev",
        uses=["__seq", "__clock"],
        __no=("sum", F.lit(1).cast("bigint")),
        __island=("sum", starts.cast("bigint")),
        __member=("since", starts),
        # a struct, so that an unknown clock of a new island hides the one before
        __lead=("last", F.when(starts, F.struct(F.date_format("__clock", "yyyyMMddHHmmss").alias("stamp")))),
    )
    group = (
        F.when(dji, F.concat_ws("_", "__family", "__lead.stamp", F.col("__island").cast("string")))
        .when(single, F.concat(F.lit("s_"), "__no"))
        .otherwise(F.col("__family"))
    )
    member = F.when(single, F.lit(1).cast("bigint")).otherwise(F.col("__member"))
    return rows.select(*files.columns, group.alias("group_id"), member.alias("member"))


def sequence_sessions(files: DataFrame) -> DataFrame:
    return sessions(files.filter(session_family(F.col("name")) == "dji"))


def chapter_sessions(files: DataFrame) -> DataFrame:
    return sessions(files.filter(session_family(F.col("name")).startswith("gopro_")))


def single_sessions(files: DataFrame) -> DataFrame:
    return sessions(files.filter(session_family(F.col("name")) == "s"))


def session_list(grouped: DataFrame) -> DataFrame:
    """One row per session, ranked by its first input index."""
    groups = grouped.groupBy("batch", "group_id").agg(
        F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("files")
    )
    return number_rows(groups, ["batch"], ["first_idx"], position_block("first_idx"), "group_no")


def reorder(grouped: DataFrame) -> DataFrame:
    """New list position with every session contiguous at its first index.

    Single files that lie inside a session's span move behind it. Spans that overlap
    form one stretch: their sessions come first, by first index, then the singles. A
    stretch covers a gapless index range, so the new position is its start plus the
    rank inside it, and no file is ever lost.
    """
    rows = group_values(
        grouped,
        ["batch", "group_id"],
        __first=F.min("idx"),
        __end=F.max("idx"),
        __n=F.count(F.lit(1)),
    )
    alone = F.col("__n") == 1
    rows = rows.withColumns(
        {c: F.when(~alone, F.col(c)) for c in ("__first", "__end")}
    )
    # the scans read their rows twice and build on each other, so what they give is stored
    reached = cut_lineage(scan(rows, ["batch"], ["idx"], position_block("idx"), __reach=("max", F.col("__end"))))
    opens = F.when(F.coalesce(F.col("idx") > F.col("__reach"), F.lit(True)), F.col("idx"))
    placed = cut_lineage(scan(reached, ["batch"], ["idx"], position_block("idx"), inclusive=True, __stretch=("last", opens)))
    placed = placed.withColumns(
        {
            "__phase": F.col("__first").isNull().cast("int"),
            "__lead": F.coalesce("__first", F.lit(0).cast("bigint")),
            "__rank": F.when(F.col("__first").isNull(), F.col("idx")).otherwise(F.col("member")),
        }
    )
    block = F.struct("__phase", "__lead", position_block("__rank"))
    ranked = number_rows(placed, ["batch", "__stretch"], ["__phase", "__lead", "__rank"], block, "__no")
    return ranked.select(*grouped.columns, (F.col("__stretch") + F.col("__no") - 1).alias("new_idx"))


def fade_flags(
    grouped: DataFrame,
    fade: float = 0.5,
    intro: bool = False,
    outro: bool = False,
) -> DataFrame:
    """Fade lengths per file: only at the outer edges of a session.

    With an intro the first file of the batch gets no fade-in, with an outro the last
    one no fade-out, and both templates appear as rows of their own.
    """
    length = max(float(fade), 0.0)
    rows = group_values(grouped, ["batch", "group_id"], __n=F.count(F.lit(1)))
    rows = group_values(rows, ["batch"], __lo=F.min("idx"), __hi=F.max("idx"))
    first, last = F.col("idx") == F.col("__lo"), F.col("idx") == F.col("__hi")
    fade_in = F.when(F.col("member") == 1, length).otherwise(0.0)
    fade_out = F.when(F.col("member") == F.col("__n"), length).otherwise(0.0)
    if intro:
        fade_in = F.when(first, 0.0).otherwise(fade_in)
    if outro:
        fade_out = F.when(last, 0.0).otherwise(fade_out)

    def entry(role: str, idx: Column, f_in: Column, f_out: Column) -> Column:
        return F.struct(
            idx.alias("idx"), F.lit(role).alias("role"), f_in.alias("fade_in"), f_out.alias("fade_out")
        )

    entries = [entry("clip", F.col("idx"), fade_in, fade_out)]
    if intro:
        entries.append(F.when(first, entry("intro", F.col("idx") - 1, F.lit(length), F.lit(0.0))))
    if outro:
        entries.append(F.when(last, entry("outro", F.col("idx") + 1, F.lit(0.0), F.lit(length))))
    return rows.select("batch", F.inline(F.array_compact(F.array(*entries))))


# ------------------------------------------------------------------ edit lists
def apply_edits(df: DataFrame, size: str, edits: Sequence[tuple], position: str = "position") -> DataFrame:
    """Apply an ordered edit list to 1-based positions; ``size`` is the list length.

    Edits are ``("swap", a, b)``, ``("move", a, b)``, ``("remove", n)`` and
    ``("order", [..])``. An edit that does not fit a list (out of range, repeated or
    missing numbers, removing the last clip) leaves that list as it is.

    Every row folds the edit list over its own position; no list is ever gathered.
    """

    def step(kind: str, a: int, b: int, target: list[int]) -> Column:
        # where a full reordering sends each old position
        sent = [target.index(i) + 1 for i in range(1, len(target) + 1)]
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(a).cast("bigint").alias("a"),
            F.lit(b).cast("bigint").alias("b"),
            F.array(*[F.lit(x) for x in sent]).cast("array<bigint>").alias("sent"),
        )

    steps = []
    for kind, *args in edits:
        if kind == "order":
            wanted = [int(x) for x in args[0]]
            if sorted(wanted) == list(range(1, len(wanted) + 1)):
                steps.append(step(kind, 0, 0, wanted))
        elif kind in ("swap", "move", "remove"):
            numbers = [int(x) for x in args]
            steps.append(step(kind, numbers[0], numbers[-1], []))
        else:
            raise ValueError(f"unknown edit {kind!r}")

    def apply(acc: Column, e: Column) -> Column:
        p, n, a, b = acc["p"], acc["n"], e["a"], e["b"]
        fits = (F.least(a, b) >= 1) & (F.greatest(a, b) <= n)
        gone = (e["kind"] == "remove") & fits & (n > 1)
        swapped = F.when(p == a, b).when(p == b, a).otherwise(p)
        moved = (
            F.when(p == a, b)
            .when((p > a) & (p <= b), p - 1)
            .when((p < a) & (p >= b), p + 1)
            .otherwise(p)
        )
        closed = F.when(p > a, p - 1).when(p < a, p)
        new = (
            F.when((e["kind"] == "swap") & fits, swapped)
            .when((e["kind"] == "move") & fits, moved)
            .when(gone, closed)
            .when((e["kind"] == "order") & (F.size(e["sent"]) == n), F.get(e["sent"], (p - 1).cast("int")))
            .otherwise(p)
        )
        return F.struct(new.alias("p"), F.when(gone, n - 1).otherwise(n).alias("n"))

    start = F.struct(F.col(position).cast("bigint").alias("p"), F.col(size).cast("bigint").alias("n"))
    final = F.aggregate(F.array(*steps), start, apply, lambda acc: acc["p"]) if steps else start["p"]
    return df.withColumn("new_position", final).filter("new_position IS NOT NULL")


def device_line(clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct devices of a batch in order of first appearance, as one text."""
    firsts = (
        clips.filter(F.coalesce("device", F.lit("")) != "")
        .groupBy(*keys, "device")
        .agg(F.min("position").alias("at"))
    )
    listed = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "device"))).alias("d"))
    return listed.select(*keys, F.array_join(F.transform("d", lambda x: x["device"]), ", ").alias("devices"))


# ------------------------------------------------------------------ logs
def silence_pairs(lines: DataFrame) -> DataFrame:
    """Silent spans from (media_id, line_no, line): an end closes the latest open start."""
    start = F.regexp_extract("line", r"silence_start:\s*([0-9.]+)", 1)
    end = F.regexp_extract("line", r"silence_end:\s*([0-9.]+)", 1)
    marks = lines.select(
        "media_id",
        "line_no",
        (start != "").alias("is_start"),
        F.when(start != "", start).otherwise(end).try_cast("double").alias("at"),
    ).filter(F.col("at").isNotNull())
    rows = previous_row(marks, ["media_id"], ["line_no"], position_block("line_no"), ["is_start", "at"])
    return rows.filter(~F.col("is_start") & F.col("prev.is_start")).select(
        "media_id",
        "line_no",
        F.col("prev.at").alias("start_s"),
        F.col("at").alias("end_s"),
        (F.col("at") - F.col("prev.at")).alias("length_s"),
    )


def number_subtitles(segments: DataFrame) -> DataFrame:
    """Non-blank segments numbered from 1 per media."""
    kept = segments.filter(F.trim("text") != "")
    return number_rows(kept, ["media_id"], ["seq"], position_block("seq"), "number")
