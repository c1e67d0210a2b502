"""Timelines, sessions, chapters, positions and interval overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplake.functions.labels import clock_label, file_stem
from cliplake.operators import catalog as C
from cliplake.operators import sequences as E
from cliplake.operators.ordered import top_rows
from cliplake.session import cut_lineage
from cliplake.plans import views as V
from cliplake.plans.registry import query

_CLOCK = "CASE WHEN {t} >= 3600 THEN ({t} // 3600) || ':' || lpad(CAST(({t} % 3600) // 60 AS VARCHAR), 2, '0') ELSE CAST(({t} % 3600) // 60 AS VARCHAR) END || ':' || lpad(CAST({t} % 60 AS VARCHAR), 2, '0')"


def clock_sql(expr: str) -> str:
    return _CLOCK.format(t=f"CAST(round_even({expr}, 0) AS BIGINT)")


def runs_sql() -> str:
    return """flags AS (SELECT *, CASE WHEN grp IS NOT NULL AND grp = lag(grp) OVER (PARTITION BY merge_id ORDER BY position) THEN 0 ELSE 1 END AS f FROM clips),
    numbered AS (SELECT *, sum(f) OVER (PARTITION BY merge_id ORDER BY position) AS run FROM flags),
    runs AS (SELECT merge_id, CAST(run AS BIGINT) AS run, min_by(name, position) AS name, sum(duration) AS duration, count(*) AS clip_count FROM numbered GROUP BY 1, 2),
    laid AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY merge_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_s FROM runs)"""


DJI = r"'^DJI_(\d{14})_(\d{4})_\w\.\w+$'"


def islands_sql(src: str) -> str:
    return rf"""dji AS (SELECT *, CAST(regexp_extract(name, {DJI}, 2, 'i') AS INT) AS seq, strptime(regexp_extract(name, {DJI}, 1, 'i'), '%Y%m%d%H%M%S') AS clk
        FROM {src} WHERE regexp_matches(name, {DJI}, 'i')),
    dflag AS (SELECT *, CASE WHEN seq = lag(seq) OVER w + 1 AND (abs(lag(size_bytes) OVER w - 4294967296) <= 4294967296 * 0.05 OR abs(lag(size_bytes) OVER w - 17179869184) <= 17179869184 * 0.05)
        AND epoch(clk) - epoch(lag(clk) OVER w) BETWEEN 0 AND 10800 THEN 0 ELSE 1 END AS f FROM dji WINDOW w AS (PARTITION BY batch ORDER BY clk, seq, idx)),
    dnum AS (SELECT *, sum(f) OVER (PARTITION BY batch ORDER BY clk, seq, idx) AS island FROM dflag),
    seq_groups AS (SELECT id, batch, idx, name, 'dji_' || strftime(first_value(clk) OVER (PARTITION BY batch, island ORDER BY clk, seq, idx), '%Y%m%d%H%M%S') || '_' || CAST(island AS BIGINT) AS group_id,
        row_number() OVER (PARTITION BY batch, island ORDER BY clk, seq, idx) AS member FROM dnum)"""


CHAPTER_SQL = r"""chap AS (SELECT *, CASE WHEN regexp_matches(name, '^GH\d{6}\.', 'i') THEN substr(name, 5, 4) WHEN regexp_matches(name, '^GOPR\d{4}\.', 'i') THEN substr(name, 5, 4)
        WHEN regexp_matches(name, '^GP\d{6}\.', 'i') THEN substr(name, 5, 4) END AS ses,
        CASE WHEN regexp_matches(name, '^GOPR', 'i') THEN 0 WHEN regexp_matches(name, '^G[HP]\d{6}\.', 'i') THEN CAST(substr(name, 3, 2) AS INT) END AS ch FROM camfiles),
    chapter_groups AS (SELECT id, batch, idx, name, 'gopro_' || ses AS group_id, row_number() OVER (PARTITION BY batch, ses ORDER BY ch, idx) AS member FROM chap WHERE ses IS NOT NULL)"""
SINGLE_SQL = """single_groups AS (SELECT id, batch, idx, name, 's_' || row_number() OVER (PARTITION BY batch ORDER BY idx) AS group_id, 1 AS member FROM camfiles WHERE name LIKE 'IMG%')"""
ALL_GROUPS = f"""{islands_sql('camfiles')}, {CHAPTER_SQL}, {SINGLE_SQL},
    grouped AS (SELECT * FROM seq_groups UNION ALL SELECT * FROM chapter_groups UNION ALL SELECT * FROM single_groups)"""


def _cam(spark, sf):
    return V.camfiles(spark, sf).select("id", "batch", "idx", "name", "creation_time", "size_bytes")


def _grouped(spark, sf):
    # the sessions are stored before other jobs read them, as a user would
    return cut_lineage(E.sessions(_cam(spark, sf)).select("id", "batch", "idx", "name", "group_id", "member"))


@query(
    "E1_latest_job",
    """SELECT video_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS r FROM jobs) WHERE r = 1""",
)
def e1(spark, sf):
    return C.latest_jobs(V.jobs(spark, sf)).select("video_id", "id", "status")


@query(
    "E2_timeline",
    """SELECT merge_id, position, name, coalesce(sum(duration) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_s,
    sum(duration) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_s FROM clips WINDOW w AS (PARTITION BY merge_id ORDER BY position)""",
)
def e2(spark, sf):
    return E.timeline(V.clips(spark, sf), ["merge_id"], short=True).select("merge_id", "position", "name", "start_s", "end_s")


@query("E3_sequence_sessions", f"WITH {islands_sql('seqfiles')} SELECT * FROM seq_groups")
def e3(spark, sf):
    return E.sequence_sessions(V.seqfiles(spark, sf)).select("id", "batch", "idx", "name", "group_id", "member")


@query("E4_chapter_sessions", f"WITH {CHAPTER_SQL} SELECT * FROM chapter_groups")
def e4(spark, sf):
    return E.chapter_sessions(_cam(spark, sf)).select("id", "batch", "idx", "name", "group_id", "member")


@query("E5_single_sessions", f"WITH {SINGLE_SQL} SELECT * FROM single_groups")
def e5(spark, sf):
    return E.single_sessions(_cam(spark, sf)).select("id", "batch", "idx", "name", "group_id", "member")


@query(
    "E5_session_list",
    f"""WITH {ALL_GROUPS}, g AS (SELECT batch, group_id, min(idx) AS first_idx, count(*) AS files FROM grouped GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY batch ORDER BY first_idx) AS group_no FROM g""",
)
def e5l(spark, sf):
    return E.session_list(_grouped(spark, sf))


@query(
    "E6_reorder_sessions",
    f"""WITH {ALL_GROUPS}, spans AS (SELECT batch, group_id, min(idx) AS f, max(idx) AS e FROM grouped GROUP BY 1, 2 HAVING count(*) > 1),
    r AS (SELECT g.*, s.f, s.e, max(s.e) OVER (PARTITION BY g.batch ORDER BY g.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM grouped g LEFT JOIN spans s USING (batch, group_id)),
    st AS (SELECT *, max(CASE WHEN reach IS NULL OR idx > reach THEN idx END) OVER (PARTITION BY batch ORDER BY idx) AS stretch FROM r)
    SELECT id, batch, idx, group_id, member, row_number() OVER (PARTITION BY batch ORDER BY stretch, (f IS NULL)::INT, coalesce(f, 0), CASE WHEN f IS NULL THEN idx ELSE member END) - 1 AS new_idx FROM st""",
)
def e6(spark, sf):
    return E.reorder(_grouped(spark, sf).drop("name"))


@query(
    "E7_fade_flags",
    f"""WITH {ALL_GROUPS}, n AS (SELECT *, count(*) OVER (PARTITION BY batch, group_id) AS n, min(idx) OVER (PARTITION BY batch) AS lo, max(idx) OVER (PARTITION BY batch) AS hi FROM grouped)
    SELECT batch, idx, 'clip' AS role, CASE WHEN idx = lo THEN 0.0::DOUBLE WHEN member = 1 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS fade_in, CASE WHEN idx = hi THEN 0.0::DOUBLE WHEN member = n THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS fade_out FROM n
    UNION ALL SELECT DISTINCT batch, lo - 1, 'intro', 0.75::DOUBLE, 0.0::DOUBLE FROM n UNION ALL SELECT DISTINCT batch, hi + 1, 'outro', 0.0::DOUBLE, 0.75::DOUBLE FROM n""",
)
def e7(spark, sf):
    return E.fade_flags(_grouped(spark, sf), 0.75, intro=True, outro=True)


@query("E8_merge_runs", f"WITH {runs_sql()} SELECT merge_id, run, name, duration, clip_count FROM runs")
def e8(spark, sf):
    return E.merge_runs(V.clips(spark, sf), ["merge_id"], short=True)


@query(
    "E9_chapters",
    f"WITH {runs_sql()} SELECT merge_id, run, start_s, start_s + duration AS end_s, {clock_sql('start_s')} AS clock, replace(name, '.mp4', '') AS title FROM laid",
)
def e9(spark, sf):
    return E.chapters(V.clips(spark, sf), ["merge_id"], short=True)


# parts of a merge: its clips cut again at every second clip's length plus ten
PARTS_SQL = """parts AS (SELECT merge_id, position AS part_no, CASE WHEN position % 2 = 0 THEN duration + 10 ELSE greatest(duration - 7, 0) END AS length FROM clips),
    part_spans AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY merge_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ps,
        sum(length) OVER (PARTITION BY merge_id ORDER BY part_no) AS pe, count(*) OVER (PARTITION BY merge_id) AS parts FROM parts)"""


def _parts(clips):
    d = F.col("duration")
    length = F.when(F.col("position") % 2 == 0, d + 10).otherwise(F.greatest(d - 7, F.lit(0.0)))
    return clips.select("merge_id", F.col("position").alias("part_no"), length.alias("length"))


def part_chapters(spark, sf):
    clips = V.clips(spark, sf)
    parts = E.timeline(_parts(clips), ["merge_id"], "part_no", "length", short=True)
    runs = E.timed_runs(clips, ["merge_id"], "grp", short=True)
    return E.overlap_parts(runs, parts, short=True)


@query(
    "E10_split_parts",
    f"WITH {PARTS_SQL} SELECT merge_id, part_no, ps AS start_s, pe AS end_s, parts, 'Trip ' || merge_id || ' (Part ' || part_no || '/' || parts || ')' AS title FROM part_spans",
)
def e10(spark, sf):
    out = E.split_parts(_parts(V.clips(spark, sf)), F.concat(F.lit("Trip "), "merge_id"), short=True)
    return out.select("merge_id", "part_no", "start_s", "end_s", "parts", "title")


@query(
    "C9_interval_overlap",
    f"""WITH {runs_sql()}, {PARTS_SQL} SELECT l.merge_id, l.run, p.part_no, greatest(0, l.start_s - p.ps) AS relative_s,
    {clock_sql('greatest(0, l.start_s - p.ps)')} AS clock, replace(l.name, '.mp4', '') AS title
    FROM laid l JOIN part_spans p ON p.merge_id = l.merge_id AND l.start_s < p.pe AND l.start_s + l.duration > p.ps""",
)
def c9(spark, sf):
    return part_chapters(spark, sf).select(
        "merge_id",
        "run",
        "part_no",
        "relative_s",
        clock_label(F.col("relative_s"), True).alias("clock"),
        file_stem(F.col("name")).alias("title"),
    )


@query(
    "E12_silence_pairs",
    """WITH m AS (SELECT media_id, line_no, line LIKE '%silence_start:%' AS s, CAST(regexp_extract(line, 'silence_(?:start|end):\\s*([0-9.]+)', 1) AS DOUBLE) AS pos
        FROM silence_log WHERE line LIKE '%silence_start:%' OR line LIKE '%silence_end:%'),
    p AS (SELECT *, lag(s) OVER w AS ps, lag(pos) OVER w AS pat FROM m WINDOW w AS (PARTITION BY media_id ORDER BY line_no))
    SELECT media_id, line_no, pat AS start_s, pos AS end_s, pos - pat AS length_s FROM p WHERE NOT s AND ps""",
)
def e12(spark, sf):
    return E.silence_pairs(V.silence_log(spark, sf))


@query(
    "E13_subtitle_numbers",
    """SELECT media_id, seq, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS number FROM
    (SELECT media_id, seq, CASE WHEN seq % 3 = 1 THEN '  ' ELSE text END AS text FROM segments) WHERE trim(text) <> ''""",
)
def e13(spark, sf):
    s = V.segments(spark, sf).withColumn("text", F.when(F.col("seq") % 3 == 1, "  ").otherwise(F.col("text")))
    return E.number_subtitles(s).select("media_id", "seq", "number")


@query(
    "F4_edit_list",
    """WITH s AS (SELECT merge_id, position, video_id, count(*) OVER (PARTITION BY merge_id) AS n FROM clips),
    a AS (SELECT *, CASE WHEN n < 3 THEN position WHEN position = 1 THEN 3 WHEN position = 3 THEN 1 ELSE position END AS p FROM s),
    b AS (SELECT * REPLACE (CASE WHEN n < 4 THEN p WHEN p = 1 THEN 4 WHEN p BETWEEN 2 AND 4 THEN p - 1 ELSE p END AS p) FROM a),
    c AS (SELECT * REPLACE (CASE WHEN n >= 2 AND p > 2 THEN p - 1 ELSE p END AS p, CASE WHEN n >= 2 THEN n - 1 ELSE n END AS n) FROM b WHERE NOT (n >= 2 AND p = 2))
    SELECT merge_id, video_id, position, CASE WHEN n = 3 THEN CASE p WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END ELSE p END AS new_position FROM c""",
)
def f4(spark, sf):
    clips = V.clips(spark, sf).select("merge_id", "position", "video_id")
    sizes = clips.groupBy("merge_id").agg(F.count(F.lit(1)).alias("n"))
    edits = [("swap", 1, 3), ("move", 1, 4), ("remove", 2), ("order", [3, 1, 2]), ("order", [1, 1, 2]), ("swap", 0, 1)]
    return E.apply_edits(clips.join(sizes, "merge_id"), "n", edits).drop("n")


@query(
    "F5_device_line",
    """SELECT merge_id, string_agg(device, ', ' ORDER BY pos) AS devices FROM (SELECT merge_id, device, min(position) AS pos FROM clips
    WHERE coalesce(device, '') <> '' GROUP BY 1, 2) GROUP BY 1""",
)
def f5(spark, sf):
    return E.device_line(V.clips(spark, sf), ["merge_id"])
