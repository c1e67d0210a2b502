"""Filters, catalogue joins, roll-ups and ordered lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cliplake.functions import predicates as P
from cliplake.operators import catalog as C
from cliplake.operators import stats as D
from cliplake.operators.ordered import number_rows
from cliplake.plans import views as V
from cliplake.plans.registry import query, ts

# one row per video with its latest job, as DuckDB text
LATEST = """latest AS (SELECT video_id, status, progress_percent FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS r FROM jobs) WHERE r = 1)"""


def catalogue_sql(where: str = "TRUE") -> str:
    return f"""WITH {LATEST}
    SELECT v.id, v.creation_text AS creation_time, substr(v.creation_text, 1, 10) AS creation_date,
        CASE WHEN trim(coalesce(v.device_model, '')) = '' THEN '미상' ELSE trim(v.device_model) END AS device,
        v.duration_seconds, coalesce(l.status, 'untracked') AS status, l.progress_percent, v.original_path AS path
    FROM videos v LEFT JOIN latest l ON v.id = l.video_id WHERE {where}"""


# ----------------------------------------------------------------------- B
@query("B1_text_search", catalogue_sql("v.creation_text ILIKE '%2024-01-01t0_:3%'"))
def b1(spark, sf):
    return C.catalogue(V.videos(spark, sf), V.jobs(spark, sf), search=" 2024-01-01t0_:3 ")


@query("B2_device_contains", catalogue_sql("v.device_model ILIKE '%brand#2%'"))
def b2(spark, sf):
    return C.catalogue(V.videos(spark, sf), V.jobs(spark, sf), device="BRAND#2", grouped=True)


@query("B3_status_untracked", catalogue_sql("l.status IS NULL"))
def b3(spark, sf):
    return C.catalogue(V.videos(spark, sf), V.jobs(spark, sf), status=" Untracked ")


@query("B3_status_completed", catalogue_sql("l.status = 'completed'"))
def b3c(spark, sf):
    return C.catalogue(V.videos(spark, sf), V.jobs(spark, sf), status="COMPLETED")


@query(
    "B4_period_prefix",
    """SELECT 'videos' AS tbl, count(*) AS cnt FROM videos WHERE strftime(creation_time, '%Y-%m-%d') LIKE '2024-01-01%'
    UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE strftime(created_at, '%Y-%m-%d') LIKE '2024-01-1%'
    UNION ALL SELECT 'merges', count(*) FROM merges WHERE strftime(created_at, '%Y-%m-%d') LIKE '1997-%'
    UNION ALL SELECT 'archive', count(*) FROM archive_history WHERE strftime(archived_at, '%Y-%m-%d') LIKE '1997-03%'
    UNION ALL SELECT 'backup', count(*) FROM backup_history WHERE strftime(backed_up_at, '%Y-%m-%d') LIKE '1998%'""",
)
def b4(spark, sf):
    parts = [
        ("videos", V.videos(spark, sf), "creation_time", "2024-01-01"),
        ("jobs", V.jobs(spark, sf), "created_at", "2024-01-1"),
        ("merges", V.merges(spark, sf), "created_at", "1997"),
        ("archive", V.archive_history(spark, sf), "archived_at", "1997-03"),
        ("backup", V.backup_history(spark, sf), "backed_up_at", "1998"),
    ]
    out = None
    for name, df, column, period in parts:
        row = df.filter(P.period_filter(F.col(column), period)).agg(
            F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("cnt")
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "B5_glob_filter",
    """SELECT id, batch, idx, name FROM camfiles
    WHERE (regexp_matches(name, '^G.*$') OR regexp_matches(lower(name), '^g.*$')
        OR regexp_matches(name, '^IMG_.*[13579]\\.MOV$') OR regexp_matches(lower(name), '^img_.*[13579]\\.mov$'))
      AND NOT (regexp_matches(name, '^..0[0-1].*\\.mp4$') OR regexp_matches(lower(name), '^..0[0-1].*\\.mp4$'))""",
)
def b5(spark, sf):
    files = V.camfiles(spark, sf).select("id", "batch", "idx", "name")
    keep = P.glob_filter(F.col("name"), ["G*", "IMG_*[13579].MOV"], ["??0[0-1]*.mp4"])
    return files.filter(keep).orderBy("batch", "idx")


@query(
    "B6_ingest_validation",
    """WITH p AS (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '') || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.MP4' ELSE '.mxf' END) AS path, length(html) % 5 = 0 AS empty FROM pages)
    SELECT page_id, CASE WHEN NOT regexp_matches(path, '[^/]\\.(mp4|mov|mts|m4v|mkv|avi|webm|m2ts|mxf)$') THEN 'unsupported extension'
        WHEN empty THEN 'empty file' END AS reason FROM p""",
)
def b6(spark, sf):
    pages = V.load(spark, sf, "pages").selectExpr(
        "page_id",
        "concat(regexp_replace(url, '[?#].*$', ''), element_at(array('', '.MP4', '.mxf'), cast(page_id % 3 + 1 AS int))) AS path",
        "CASE WHEN length(html) % 5 = 0 THEN 0 ELSE length(html) END AS size",
    )
    return pages.select("page_id", P.ingest_reason(F.col("path"), F.col("size")).alias("reason"))


@query(
    "B7_needs_device_scan",
    "SELECT id, original_path FROM videos WHERE device_model IS NULL OR device_model = '' OR device_model = 'Nikon' OR device_model ILIKE 'Apple iPhone%'",
)
def b7(spark, sf):
    v = V.videos(spark, sf)
    return v.filter(P.needs_device_scan(F.col("device_model"), True)).select("id", "original_path").orderBy("id")


@query(
    "B8_resumable_jobs",
    f"SELECT id, video_id, temp_file_path, {ts('started_at')} AS started_at FROM jobs WHERE status = 'processing' AND temp_file_path IS NOT NULL",
)
def b8(spark, sf):
    return C.unfinished_jobs(V.jobs(spark, sf), resumable=True).select(
        "id", "video_id", "temp_file_path", "started_at"
    )


@query("B9_uploaded_merges", "SELECT id, youtube_id, output_path FROM merges WHERE youtube_id IS NOT NULL")
def b9(spark, sf):
    m = V.merges(spark, sf).filter(F.col("youtube_id").isNotNull()).orderBy(*C.newest())
    return m.select("id", "youtube_id", "output_path")


@query("B10_jobs_of_video", f"SELECT id, status, {ts('created_at')} AS created_at FROM jobs WHERE video_id = 7")
def b10(spark, sf):
    return C.lookup(V.jobs(spark, sf), order=C.newest(), video_id=7).select("id", "status", "created_at")


@query(
    "B10_newest_by_path",
    """SELECT output_path, id, status FROM (SELECT *, row_number() OVER
        (PARTITION BY output_path ORDER BY created_at DESC, id DESC) AS r FROM merges) WHERE r = 1""",
)
def b10n(spark, sf):
    return C.newest_per(V.merges(spark, sf).select("output_path", "id", "status", "created_at"), "output_path").drop(
        "created_at"
    )


_ASKED = "SELECT event_id * 7 % 5000 AS k FROM events WHERE event_id % 5 = 0"
_ASKED_NAMES = """SELECT 'Customer#' || lpad(CAST(event_id % 900 AS VARCHAR), 9, '0') AS k FROM events WHERE event_id % 5 = 0"""


def _asked(spark, sf, key="event_id * 7 % 5000"):
    return V.load(spark, sf, "events").where("event_id % 5 = 0").selectExpr(f"{key} AS k")


@query("B10_video_by_id", f"SELECT id, original_path, device_model FROM videos WHERE id IN ({_ASKED})")
def b10v(spark, sf):
    return C.lookup_many(V.videos(spark, sf), _asked(spark, sf), "id").select("id", "original_path", "device_model")


@query("B10_video_by_path", f"SELECT id, original_path FROM videos WHERE original_path IN (SELECT original_path FROM videos WHERE id IN ({_ASKED}))")
def b10p(spark, sf):
    videos = V.videos(spark, sf)
    paths = videos.join(_asked(spark, sf), F.col("id") == F.col("k"), "left_semi").select("original_path")
    return C.lookup_many(videos, paths, "original_path").select("id", "original_path")


@query("B10_project_by_name", f"SELECT id, name FROM projects WHERE name IN ({_ASKED_NAMES})")
def b10m(spark, sf):
    names = _asked(spark, sf, "concat('Customer#', lpad(event_id % 900, 9, '0'))")
    return C.lookup_many(V.projects(spark, sf), names, "name").select("id", "name")


@query("B10_splits_of_merge", f"SELECT merge_job_id, id, status, row_number() OVER (PARTITION BY merge_job_id ORDER BY id) AS place FROM splits WHERE merge_job_id IN ({_ASKED})")
def b10s(spark, sf):
    found = C.lookup_many(V.splits(spark, sf), _asked(spark, sf), "merge_job_id", [F.col("id")])
    return found.select("merge_job_id", "id", "status", "place")


@query(
    "B10_archive_of_video",
    f"SELECT video_id, id, operation, row_number() OVER (PARTITION BY video_id ORDER BY archived_at DESC, id DESC) AS place FROM archive_history WHERE video_id IN ({_ASKED})",
)
def b10a(spark, sf):
    order = [F.desc("archived_at"), F.desc("id")]
    found = C.lookup_many(V.archive_history(spark, sf), _asked(spark, sf), "video_id", order)
    return found.select("video_id", "id", "operation", "place")


@query(
    "B10_backups_of_merge",
    f"SELECT merge_job_id, id, success, row_number() OVER (PARTITION BY merge_job_id ORDER BY backed_up_at DESC, id DESC) AS place FROM backup_history WHERE merge_job_id IN ({_ASKED})",
)
def b10b(spark, sf):
    order = [F.desc("backed_up_at"), F.desc("id")]
    found = C.lookup_many(V.backup_history(spark, sf), _asked(spark, sf), "merge_job_id", order)
    return found.select("merge_job_id", "id", "success", "place")


@query(
    "B11_upload_limits",
    """WITH m AS (SELECT id, total_size_bytes * 700 AS size, CASE WHEN id % 10 = 0 THEN 0.0 ELSE total_duration_seconds END AS dur FROM merges),
    e AS (SELECT id, size, dur, size > 274877906944 AS big, dur > 43200 AS lng FROM m)
    SELECT id, NOT (big OR lng) AS is_valid,
      concat_ws(';', CASE WHEN big THEN '파일 크기 초과 (' || printf('%.1f', (size - 274877906944) / 1073741824.0) || 'GB 초과)' END,
        CASE WHEN lng THEN '영상 길이 초과 (' || printf('%.1f', (dur - 43200) / 3600.0) || '시간 초과)' END) AS errors,
      concat_ws(';', CASE WHEN NOT big AND size > 274877906944 * 0.9 THEN '파일 크기가 제한에 근접함' END,
        CASE WHEN NOT lng AND dur > 43200 * 0.9 THEN '영상 길이가 제한에 근접함' END,
        CASE WHEN dur = 0 THEN '영상 길이를 확인할 수 없음 (ffprobe 필요)' END) AS warnings FROM e""",
)
def b11(spark, sf):
    m = V.merges(spark, sf).select(
        "id",
        (F.col("total_size_bytes") * 700).alias("size"),
        F.when(F.col("id") % 10 == 0, 0.0).otherwise(F.col("total_duration_seconds")).alias("dur"),
    )
    checked = m.select("id", P.upload_check(F.col("size"), F.col("dur")).alias("c"))
    return checked.select(
        "id",
        "c.is_valid",
        F.concat_ws(";", "c.errors").alias("errors"),
        F.concat_ws(";", "c.warnings").alias("warnings"),
    )


@query(
    "B12_metadata_rules",
    """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, concat_ws(',',
        CASE WHEN l_quantity - 5 <= 0 THEN 'width' END, CASE WHEN l_linenumber - 2 <= 0 THEN 'height' END,
        CASE WHEN l_tax <= 0 THEN 'duration' END, CASE WHEN l_discount <= 0 THEN 'fps' END,
        CASE WHEN NOT (l_quantity * 2) BETWEEN -90 AND 90 THEN 'latitude' END,
        CASE WHEN NOT (l_quantity * 4) BETWEEN -180 AND 180 THEN 'longitude' END) AS faults FROM lineitem""",
)
def b12(spark, sf):
    li = V.load(spark, sf, "lineitem")
    q = F.col("l_quantity")
    faults = P.metadata_faults(
        q - 5, F.col("l_linenumber") - 2, F.col("l_tax"), F.col("l_discount"), q * 2, q * 4
    )
    return li.select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("p"),
        F.concat_ws(",", faults).alias("faults"),
    )


# ----------------------------------------------------------------------- C
@query("C1_catalog_latest", catalogue_sql())
def c1(spark, sf):
    return C.catalogue(V.videos(spark, sf), V.jobs(spark, sf))


@query(
    "C2_active_jobs",
    f"""SELECT j.id, j.video_id, j.status, v.original_path, {ts('j.created_at')} AS created_at
    FROM jobs j JOIN videos v ON v.id = j.video_id WHERE j.status IN ('pending', 'processing')
    ORDER BY j.created_at DESC, j.id DESC LIMIT 25""",
)
def c2(spark, sf):
    return C.active_jobs(V.jobs(spark, sf), V.videos(spark, sf), 25).select(
        "id", "video_id", "status", "original_path", "created_at"
    )


@query(
    "C3_archive_paths",
    f"""SELECT h.id, h.video_id, h.operation, {ts('h.archived_at')} AS archived_at, v.original_path AS current_path
    FROM (SELECT * FROM archive_history ORDER BY archived_at DESC, id DESC, video_id DESC LIMIT 100) h
    LEFT JOIN videos v ON v.id = h.video_id""",
)
def c3(spark, sf):
    return C.archive_with_paths(V.archive_history(spark, sf), V.videos(spark, sf)).select(
        "id", "video_id", "operation", "archived_at", "current_path"
    )


@query(
    "C4_project_merges",
    "SELECT l.project_id, l.merge_job_id, m.date, m.output_path FROM links l JOIN merges m ON m.id = l.merge_job_id",
)
def c4(spark, sf):
    return C.project_merges(V.links(spark, sf), V.merges(spark, sf)).select(
        "project_id", "merge_job_id", "date", "output_path"
    )


@query(
    "C5_project_members",
    """SELECT p.id, p.name, l.merge_job_id, m.date, m.youtube_id FROM projects p
    LEFT JOIN links l ON l.project_id = p.id LEFT JOIN merges m ON m.id = l.merge_job_id""",
)
def c5(spark, sf):
    return C.project_members(V.projects(spark, sf), V.links(spark, sf), V.merges(spark, sf)).select(
        "id", "name", "merge_job_id", "date", "youtube_id"
    )


@query(
    "C6_id_list_delete",
    "SELECT id, video_id, status FROM jobs WHERE video_id NOT IN (SELECT id FROM videos WHERE device_model IS NULL)",
)
def c6(spark, sf):
    ids = V.videos(spark, sf).filter(F.col("device_model").isNull()).select("id")
    jobs = V.jobs(spark, sf).select("id", "video_id", "status")
    return C.in_id_list(jobs, ids, "video_id", negate=True)


@query(
    "C7_merge_members",
    """WITH x AS (SELECT id AS merge_id, CAST(json_extract(video_ids, '$') AS BIGINT[]) AS ids FROM merges WHERE json_valid(video_ids)),
    y AS (SELECT merge_id, unnest(range(0, len(ids))) AS position, unnest(ids) AS video_id FROM x)
    SELECT y.merge_id, y.position, y.video_id, v.original_path FROM y LEFT JOIN videos v ON v.id = y.video_id""",
)
def c7(spark, sf):
    return C.merge_members(V.merges(spark, sf), V.videos(spark, sf))


# ----------------------------------------------------------------------- D
@query(
    "D1_video_totals",
    "SELECT count(*) AS total_videos, round(coalesce(sum(duration_seconds), 0), 6) AS total_duration FROM videos",
)
def d1(spark, sf):
    return D.video_totals(V.videos(spark, sf))


@query("D2_device_distribution", "SELECT coalesce(device_model, '미상') AS device, count(*) AS cnt FROM videos GROUP BY 1")
def d2(spark, sf):
    return D.device_distribution(V.videos(spark, sf)).orderBy(F.desc("cnt"), "device")


@query("D3_status_counts", "SELECT status, count(*) AS cnt FROM jobs GROUP BY 1")
def d3(spark, sf):
    return D.status_counts(V.jobs(spark, sf))


SUMMARY = """count(*) FILTER (status IN ('completed', 'merged')) AS completed, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) AS total,
    round(CASE WHEN count(*) > 0 THEN count(*) FILTER (status IN ('completed', 'merged')) * 100.0 / count(*) END, 6) AS success_rate"""


@query("D4_transcode_summary", f"SELECT {SUMMARY} FROM jobs")
def d4(spark, sf):
    return D.transcode_summary(V.jobs(spark, sf))


SPEED = """SELECT round(nullif(avg(v.duration_seconds / greatest((epoch_us(j.completed_at) - epoch_us(j.started_at)) / 1e6, 0.001)), 0), 6) AS avg_speed
    FROM jobs j JOIN videos v ON v.id = j.video_id WHERE j.status IN ('completed', 'merged') AND v.duration_seconds > 0
    AND j.completed_at > j.started_at"""


@query("D5_average_speed", SPEED)
def d5(spark, sf):
    return D.average_speed(V.jobs(spark, sf), V.videos(spark, sf))


ROLLUP = """count(*) AS merge_total, count(*) FILTER (status = 'completed') AS merge_completed,
    count(*) FILTER (status = 'failed') AS merge_failed, count(youtube_id) AS merge_uploaded,
    CAST(coalesce(sum(total_size_bytes), 0) AS BIGINT) AS merge_size_bytes, round(coalesce(sum(total_duration_seconds), 0), 4) AS merge_duration"""


@query("D6_merge_rollup", f"SELECT {ROLLUP} FROM merges")
def d6(spark, sf):
    return D.merge_rollup(V.merges(spark, sf)).withColumn("merge_duration", F.round("merge_duration", 4))


@query(
    "D7_archive_backup_counts",
    """SELECT (SELECT count(*) FROM archive_history WHERE operation = 'move') AS moved,
    (SELECT count(*) FROM archive_history WHERE operation = 'delete') AS deleted,
    (SELECT count(*) FROM backup_history WHERE success) AS backups_ok,
    (SELECT count(*) FROM backup_history WHERE NOT success) AS backups_failed""",
)
def d7(spark, sf):
    return D.one_row(D.archive_counts(V.archive_history(spark, sf)), D.backup_counts(V.backup_history(spark, sf)))


@query(
    "D8_project_rollup",
    f"""SELECT p.id, p.name, count(l.merge_job_id) AS total_count, round(coalesce(sum(m.total_duration_seconds), 0), 4) AS total_duration_seconds,
    CAST(coalesce(sum(m.total_size_bytes), 0) AS BIGINT) AS total_size_bytes, count(m.youtube_id) AS uploaded_count, {ts('p.updated_at')} AS updated_at
    FROM projects p LEFT JOIN links l ON l.project_id = p.id LEFT JOIN merges m ON m.id = l.merge_job_id GROUP BY p.id, p.name, p.updated_at""",
)
def d8(spark, sf):
    return (
        D.project_rollup(V.projects(spark, sf), V.links(spark, sf), V.merges(spark, sf))
        .orderBy(F.desc("updated_at"), F.desc("id"))
        .select(
            "id",
            "name",
            "total_count",
            F.round("total_duration_seconds", 4).alias("total_duration_seconds"),
            "total_size_bytes",
            "uploaded_count",
            "updated_at",
        )
    )


@query(
    "D9_project_date_range",
    """SELECT l.project_id, min(m.date) AS date_range_start, max(m.date) AS date_range_end
    FROM links l LEFT JOIN merges m ON m.id = l.merge_job_id GROUP BY 1""",
)
def d9(spark, sf):
    return D.project_date_range(V.links(spark, sf), V.merges(spark, sf))


@query(
    "D10_project_detail",
    """SELECT p.id, p.name, count(l.merge_job_id) AS total_count, round(coalesce(sum(m.total_duration_seconds), 0), 4) AS total_duration_seconds,
    CAST(coalesce(sum(m.total_size_bytes), 0) AS BIGINT) AS total_size_bytes, count(*) FILTER (coalesce(m.youtube_id, '') <> '') AS uploaded_count
    FROM projects p LEFT JOIN links l ON l.project_id = p.id LEFT JOIN merges m ON m.id = l.merge_job_id GROUP BY p.id, p.name""",
)
def d10(spark, sf):
    out = D.project_detail(V.projects(spark, sf), V.links(spark, sf), V.merges(spark, sf))
    return out.withColumn("total_duration_seconds", F.round("total_duration_seconds", 4))


@query(
    "D10_project_dates",
    """SELECT project_id, date, (r - 1) // 2 AS part, count(*) AS merge_count, '[' || string_agg(CAST(merge_job_id AS VARCHAR), ',' ORDER BY merge_job_id) || ']' AS merge_ids
    FROM (SELECT l.project_id, coalesce(m.date, '날짜 미상') AS date, l.merge_job_id, row_number() OVER (PARTITION BY l.project_id, coalesce(m.date, '날짜 미상') ORDER BY l.merge_job_id) AS r
      FROM links l JOIN merges m ON m.id = l.merge_job_id) GROUP BY 1, 2, 3""",
)
def d10d(spark, sf):
    return D.project_dates(V.links(spark, sf), V.merges(spark, sf), ids_per_row=2)


@query(
    "D11_catalogue_summary",
    "SELECT count(*) AS total, strftime(min(creation_time), '%Y-%m-%d') AS date_start, strftime(max(creation_time), '%Y-%m-%d') AS date_end FROM videos",
)
def d11(spark, sf):
    return D.catalogue_summary(C.catalogue(V.videos(spark, sf), V.jobs(spark, sf), ordered=False))


@query(
    "D11_device_counts",
    "SELECT CASE WHEN trim(coalesce(device_model, '')) = '' THEN '미상' ELSE trim(device_model) END AS device, count(*) AS cnt FROM videos GROUP BY 1",
)
def d11d(spark, sf):
    return D.device_counts(C.catalogue(V.videos(spark, sf), V.jobs(spark, sf), ordered=False))


@query(
    "D12_dashboard",
    f"""SELECT * FROM (SELECT count(*) AS total_videos, round(coalesce(sum(duration_seconds), 0), 4) AS total_duration FROM videos WHERE creation_time < TIMESTAMP '2024-02-01'),
    (SELECT count(*) AS device_count, max_by(device, (cnt, device)) AS top_device FROM (SELECT coalesce(device_model, '미상') AS device, count(*) AS cnt FROM videos WHERE creation_time < TIMESTAMP '2024-02-01' GROUP BY 1)),
    (SELECT {SUMMARY} FROM jobs WHERE strftime(created_at, '%Y-%m') = '2024-01'), ({SPEED} AND strftime(j.created_at, '%Y-%m') = '2024-01'),
    (SELECT {ROLLUP} FROM merges WHERE strftime(created_at, '%Y-%m') = '2024-01'),
    (SELECT count(*) FILTER (operation = 'move') AS moved, count(*) FILTER (operation = 'delete') AS deleted FROM archive_history WHERE strftime(archived_at, '%Y-%m') = '2024-01')""",
)
def d12(spark, sf):
    out = D.dashboard(
        V.videos(spark, sf), V.jobs(spark, sf), V.merges(spark, sf), V.archive_history(spark, sf), "2024-01"
    )
    return out.withColumn("total_duration", F.round("total_duration", 4)).withColumn(
        "merge_duration", F.round("merge_duration", 4)
    )


@query(
    "D12_dashboard_all",
    f"""SELECT * FROM (SELECT count(*) AS total_videos, round(coalesce(sum(duration_seconds), 0), 4) AS total_duration FROM videos),
    (SELECT count(*) AS device_count, max_by(device, (cnt, device)) AS top_device FROM (SELECT coalesce(device_model, '미상') AS device, count(*) AS cnt FROM videos GROUP BY 1)),
    (SELECT {SUMMARY} FROM jobs), ({SPEED}), (SELECT {ROLLUP} FROM merges),
    (SELECT count(*) FILTER (operation = 'move') AS moved, count(*) FILTER (operation = 'delete') AS deleted FROM archive_history)""",
)
def d12a(spark, sf):
    out = D.dashboard(V.videos(spark, sf), V.jobs(spark, sf), V.merges(spark, sf), V.archive_history(spark, sf))
    return out.withColumn("total_duration", F.round("total_duration", 4)).withColumn(
        "merge_duration", F.round("merge_duration", 4)
    )


@query(
    "D12_dashboard_devices",
    """SELECT row_number() OVER (ORDER BY cnt DESC, device) AS place, device, cnt FROM
    (SELECT coalesce(device_model, '미상') AS device, count(*) AS cnt FROM videos WHERE creation_time < TIMESTAMP '2024-02-01' GROUP BY 1)""",
)
def d12d(spark, sf):
    return D.dashboard_devices(V.videos(spark, sf), "2024-01")


@query(
    "D13_table_counts",
    """SELECT (SELECT count(*) FROM videos) AS videos, (SELECT count(*) FROM merges) AS merges,
    (SELECT count(youtube_id) FROM merges) AS uploaded, (SELECT count(*) FROM projects) AS projects""",
)
def d13(spark, sf):
    return D.table_counts(V.videos(spark, sf), V.merges(spark, sf), V.projects(spark, sf))


@query(
    "D14_device_shares",
    """WITH d AS (SELECT coalesce(device_model, '미상') AS device, count(*) AS cnt FROM videos GROUP BY 1)
    SELECT device, cnt, round(cnt * 100.0 / sum(cnt) OVER (), 6) AS percent,
    greatest(1, CAST(floor(cnt / max(cnt) OVER () * 30) AS BIGINT)) AS bar, CAST(floor(30 * cnt / sum(cnt) OVER ()) AS BIGINT) AS share_bar FROM d""",
)
def d14(spark, sf):
    return D.device_shares(D.device_distribution(V.videos(spark, sf)))


@query("D15_space_estimate", "SELECT folder, CAST(floor(sum(size_bytes) * 1.5) AS BIGINT) AS required_bytes FROM videos GROUP BY 1")
def d15(spark, sf):
    return D.space_estimate(V.videos(spark, sf), "folder")


@query(
    "D19_status_overview",
    """SELECT 'active' AS section, id, status AS detail FROM (SELECT j.id, j.status FROM jobs j JOIN videos v ON v.id = j.video_id
        WHERE j.status IN ('pending', 'processing') ORDER BY j.created_at DESC, j.id DESC LIMIT 10)
    UNION ALL SELECT 'recent', id, output_path FROM (SELECT * FROM merges ORDER BY created_at DESC, id DESC LIMIT 10)
    UNION ALL SELECT 'videos', count(*), NULL FROM videos UNION ALL SELECT 'merges', count(*), NULL FROM merges
    UNION ALL SELECT 'uploaded', count(youtube_id), NULL FROM merges""",
)
def d19(spark, sf):
    videos, merges = V.videos(spark, sf), V.merges(spark, sf)
    active = C.active_jobs(V.jobs(spark, sf), videos).select(
        F.lit("active").alias("section"), "id", F.col("status").alias("detail")
    )
    recent = C.newest_rows(merges).select(F.lit("recent").alias("section"), "id", F.col("output_path").alias("detail"))
    counts = D.table_counts(videos, merges, V.projects(spark, sf)).selectExpr(
        "stack(3, 'videos', videos, 'merges', merges, 'uploaded', uploaded) AS (section, id)", "cast(NULL AS string) AS detail"
    )
    return active.unionByName(recent).unionByName(counts)


# ----------------------------------------------------------------------- F
@query(
    "F1_clip_positions",
    """SELECT id, batch, name, row_number() OVER (PARTITION BY batch ORDER BY size_bytes, idx) AS position FROM camfiles""",
)
def f1p(spark, sf):
    files = V.camfiles(spark, sf)
    return number_rows(files, ["batch"], ["size_bytes", "idx"], F.expr("struct(size_bytes, idx div 4096)"), "position").select(
        "id", "batch", "name", "position"
    )


_SORTS = {
    "by_time": "creation_time, idx", "by_name": "lower(name), idx", "by_size": "size_bytes, idx",
    "by_device": "coalesce(device, ''), creation_time, idx", "by_device_back": "coalesce(device, '') DESC, creation_time DESC, idx",
}


@query(
    "F1_clip_sort",
    f"SELECT id, batch, idx, {', '.join(f'row_number() OVER (PARTITION BY batch ORDER BY {o}) AS {n}' for n, o in _SORTS.items())} FROM camfiles",
)
def f1(spark, sf):
    """The position of every file in its batch under each order."""
    orders = {n: C.clip_sort(n.split("_")[1], reverse=n.endswith("back")) for n in _SORTS}
    places = {n: F.row_number().over(Window.partitionBy("batch").orderBy(*o)) for n, o in orders.items()}
    return V.camfiles(spark, sf).withColumns(places).select("id", "batch", "idx", *_SORTS)


@query(
    "F2_grouped_order",
    """SELECT id, device_model, row_number() OVER (PARTITION BY coalesce(device_model, '') ORDER BY device_model NULLS FIRST, creation_time DESC, id DESC) AS position FROM videos""",
)
def f2(spark, sf):
    """The position of every video below its device in the grouped catalogue order."""
    group = Window.partitionBy(F.coalesce("device_model", F.lit(""))).orderBy(*C.grouped_order())
    return V.videos(spark, sf).select("id", "device_model", F.row_number().over(group).alias("position"))


@query("F3_newest_merges", "SELECT id, output_path FROM merges ORDER BY created_at DESC, id DESC LIMIT 10")
def f3(spark, sf):
    return C.newest_rows(V.merges(spark, sf)).select("id", "output_path")


