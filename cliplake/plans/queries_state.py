"""Sources, sinks, set operations and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplake.operators import catalog as C
from cliplake.operators import extract as I
from cliplake.operators import sequences as E
from cliplake.operators import state as K
from cliplake.plans import views as V
from cliplake.plans.queries_sequences import clock_sql, runs_sql
from cliplake.plans.registry import query, ts
from cliplake.schemas import ALLOWED, PARENTS, PATH_COLUMNS, TABLES, UNIQUE_KEYS
from cliplake.sources import inventory as INV
from cliplake.sources import reports as R
from cliplake.sources import snapshot as SNAP
from cliplake.sources import tables as T

c = F.col


def _now():
    """A fixed present, so that reruns give the same rows."""
    return F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")


def _tables(spark, sf):
    return {
        "projects": V.projects(spark, sf),
        "videos": V.videos(spark, sf),
        "transcoding_jobs": V.jobs(spark, sf),
        "merge_jobs": V.merges(spark, sf),
        "split_jobs": V.splits(spark, sf),
        "archive_history": V.archive_history(spark, sf),
        "backup_history": V.backup_history(spark, sf),
        "project_merge_jobs": V.links(spark, sf),
    }


# columns of every table as the views have them; t marks times, d doubles, in the order of the layout
_COLUMNS = {
    "projects": ("projects", "id name description created_at:t updated_at:t"),
    "videos": ("videos", "id original_path creation_time:t duration_seconds:d device_model is_portrait"),
    "transcoding_jobs": ("jobs", "id video_id temp_file_path status progress_percent started_at:t completed_at:t error_message created_at:t"),
    "merge_jobs": ("merges", "id output_path video_ids status youtube_id title date total_duration_seconds:d total_size_bytes created_at:t"),
    "split_jobs": ("splits", "id merge_job_id split_criterion output_files youtube_ids status created_at:t"),
    "archive_history": ("archive_history", "id video_id operation original_path destination_path archived_at:t"),
    "backup_history": ("backup_history", "id merge_job_id source_path remote source_type success error_message backed_up_at:t"),
    "project_merge_jobs": ("links", "project_id merge_job_id added_at:t"),
}


def _fields(table):
    return [f.partition(":")[::2] for f in _COLUMNS[table][1].split()]


def _keyed(tables, *more):
    """Every row of every table as one text of all its columns."""

    def text(name, kind):
        value = F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS") if kind == "t" else F.round(c(name) * 1000).cast("bigint") if kind == "d" else c(name)
        return F.coalesce(value.cast("string"), F.lit("~"))

    out = None
    for table, df in tables.items():
        rows = df.select(F.lit(table).alias("tbl"), F.concat_ws("|", *[text(*f) for f in _fields(table)]).alias("row"), *more)
        out = rows if out is None else out.unionByName(rows)
    return out


def _keyed_sql(sources, **more):
    """The same in SQL; ``sources`` gives what follows FROM, where it is not the whole view."""
    parts = []
    for table, (view, _) in _COLUMNS.items():
        if sources.get(table, view) is None:
            continue
        texts = [f"coalesce(CAST({ts(n) if k == 't' else f'CAST(round({n} * 1000) AS BIGINT)' if k == 'd' else n} AS VARCHAR), '~')" for n, k in _fields(table)]
        extra = "".join(f", {m[table]} AS {n}" for n, m in more.items())
        parts.append(f"SELECT '{table}' AS tbl, concat_ws('|', {', '.join(texts)}) AS row{extra} FROM {sources.get(table, view)}")
    return " UNION ALL ".join(parts)


# ----------------------------------------------------------------------- A
# what is wrong with the tables of A1: rows lost, rows met twice, values out of range
_LOST = {"projects": "id % 25 = 0", "videos": "id % 20 = 0", "merge_jobs": "id % 33 = 0"}
_TWICE = {
    "projects": "id % 90 = 1", "videos": "id % 70 = 3", "transcoding_jobs": "id % 110 = 5", "merge_jobs": "id % 130 = 2", "split_jobs": "id % 60 = 4",
    "archive_history": "id % 300 = 8", "backup_history": "id % 500 = 3", "project_merge_jobs": "merge_job_id % 150 = 6",
}
_WRONG = {
    "transcoding_jobs": {"status": "CASE WHEN id % 100 = 0 THEN 'lost' ELSE status END", "progress_percent": "CASE WHEN id % 120 = 7 THEN 101 ELSE progress_percent END"},
    "merge_jobs": {"status": "CASE WHEN id % 50 = 0 THEN 'merged' ELSE status END"},
    "split_jobs": {"status": "CASE WHEN id % 40 = 1 THEN NULL ELSE status END", "split_criterion": "CASE WHEN id % 45 = 2 THEN 'bytes' ELSE split_criterion END"},
    "archive_history": {"operation": "CASE WHEN id % 77 = 1 THEN 'copy' ELSE operation END"},
    "backup_history": {"source_type": "CASE WHEN id % 88 = 2 THEN 'tape' ELSE source_type END"},
}


def _broken_sql():
    out = []
    for table, (view, _) in _COLUMNS.items():
        new = ", ".join(f"{e} AS {n}" for n, e in _WRONG.get(table, {}).items())
        kept = f"(SELECT * FROM {view} WHERE NOT ({_LOST[table]}))" if table in _LOST else view
        out.append(f"b_{table} AS (SELECT *{f' REPLACE ({new})' if new else ''} FROM (SELECT * FROM {kept} UNION ALL SELECT * FROM {kept} WHERE {_TWICE[table]}))")
    return ", ".join(out)


def _rules_sql():
    def row(table, rule, source):
        return f"SELECT '{table}' AS tbl, '{rule}' AS rule, count(*) AS offending FROM {source}"

    parts = []
    for table, keys in UNIQUE_KEYS.items():
        parts += [row(table, f"unique {','.join(k)}", f"(SELECT 1 FROM b_{table} WHERE {' AND '.join(f'{x} IS NOT NULL' for x in k)} GROUP BY {', '.join(k)} HAVING count(*) > 1)") for k in keys]
    for (table, column), allowed in ALLOWED.items():
        listed = ", ".join(f"'{x}'" for x in allowed)
        parts.append(row(table, f"allowed {column}", f"b_{table} WHERE coalesce({column} NOT IN ({listed}), true)"))
    parts.append(row("transcoding_jobs", "range progress_percent", "b_transcoding_jobs WHERE progress_percent NOT BETWEEN 0 AND 100"))
    parts += [row(child, f"parent {column}", f"b_{child} WHERE {column} NOT IN (SELECT id FROM b_{parent})") for (child, column), parent in PARENTS.items()]
    return f"WITH {_broken_sql()} " + " UNION ALL ".join(parts)


@query("A1_violations", _rules_sql())
def a1(spark, sf):
    """All rules on tables in which each of them is broken."""
    broken = {}
    for name, df in _tables(spark, sf).items():
        kept = df.where(f"NOT ({_LOST[name]})") if name in _LOST else df
        broken[name] = kept.unionByName(kept.where(_TWICE[name])).withColumns({n: F.expr(e) for n, e in _WRONG.get(name, {}).items()})
    return T.violations(broken)


@query(
    "A2_file_inventory",
    """WITH f AS (SELECT CASE WHEN id % 4 = 0 THEN replace(original_path, '.mp4', '.MOV') WHEN id % 4 = 1 THEN replace(original_path, '.mp4', '.txt') ELSE original_path END AS path, creation_text AS creation_time, size_bytes FROM videos)
    SELECT path, min(creation_time) AS creation_time, max(size_bytes) AS size_bytes FROM f WHERE path NOT LIKE '%.txt' GROUP BY 1""",
)
def a2(spark, sf):
    # the paths of the videos as a listing, some with other suffixes, each met twice
    listing = V.videos(spark, sf).selectExpr(
        "CASE id % 4 WHEN 0 THEN replace(original_path, '.mp4', '.MOV') WHEN 1 THEN replace(original_path, '.mp4', '.txt') ELSE original_path END AS path",
        "creation_text AS creation_time",
        "size_bytes",
    )
    return INV.wanted_files(listing.unionByName(listing), extensions=[".mp4", ".mov"])


_ROOT_SQL = """SELECT id, size_bytes, CASE id % 5 WHEN 0 THEN '/Volumes/card' || (id % 7) || original_path WHEN 1 THEN '/mnt/nas' || (id % 3) || original_path WHEN 2 THEN '/mnt' WHEN 3 THEN '/mntx/a.mp4' ELSE original_path END AS path FROM videos"""


@query(
    "A3_storage_roots",
    f"""WITH p AS ({_ROOT_SQL}) SELECT CASE WHEN path LIKE '/Volumes/%' THEN '/Volumes/' || regexp_extract(path, '^/Volumes/([^/]+)', 1) WHEN path LIKE '/mnt/%' THEN '/mnt/' || regexp_extract(path, '^/mnt/([^/]+)', 1)
    WHEN path = '/mnt' THEN '/mnt' END AS root, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM p GROUP BY 1""",
)
def a3(spark, sf):
    files = V.videos(spark, sf).selectExpr(
        "size_bytes",
        "CASE id % 5 WHEN 0 THEN concat('/Volumes/card', id % 7, original_path) WHEN 1 THEN concat('/mnt/nas', id % 3, original_path)"
        " WHEN 2 THEN '/mnt' WHEN 3 THEN '/mntx/a.mp4' ELSE original_path END AS path",
    )
    return INV.storage_rollup(files)


@query(
    "A4_snapshot_manifest",
    """SELECT * FROM (VALUES (0, 'projects', 1), (1, 'videos', 1), (2, 'transcoding_jobs', 1), (3, 'merge_jobs', 1), (4, 'split_jobs', 1), (5, 'archive_history', 1), (6, 'backup_history', 1), (7, 'project_merge_jobs', 1)) AS t(position, tbl, format_version)
    JOIN (SELECT 0 AS position, count(*) AS row_count FROM projects UNION ALL SELECT 1, count(*) FROM videos UNION ALL SELECT 2, count(*) FROM jobs UNION ALL SELECT 3, count(*) FROM merges
      UNION ALL SELECT 4, count(*) FROM splits UNION ALL SELECT 5, count(*) FROM archive_history UNION ALL SELECT 6, count(*) FROM backup_history UNION ALL SELECT 7, count(*) FROM links) USING (position)""",
)
def a4(spark, sf):
    return SNAP.manifest(_tables(spark, sf))


# rows that the current catalogue lacks before the import, by table
_LACKING = {
    "projects": "id % 7 = 0", "videos": "device_model IS NULL", "transcoding_jobs": "id % 3 = 0", "merge_jobs": "id % 2 = 1",
    "split_jobs": "id % 5 = 0", "archive_history": "id % 4 = 1", "backup_history": "id % 2 = 0", "project_merge_jobs": "project_id % 3 = 0",
}
_UNSENT = "device_model IS NULL AND original_path LIKE '%/ECONOMY/%'"


@query(
    "A5_snapshot_import",
    _keyed_sql({"videos": f"videos WHERE NOT ({_UNSENT})"}, inserted={t: f"({x})" for t, x in _LACKING.items()}),
)
def a5(spark, sf):
    """All tables are imported into a catalogue that lacks some rows of each."""
    tables = _tables(spark, sf)
    rows = SNAP.snapshot_rows(tables)
    merged = {}
    for name, df in tables.items():
        incoming = SNAP.table_from_rows(rows, name)
        if name == "videos":
            incoming = incoming.filter(f"NOT ({_UNSENT})")
        merged[name] = SNAP.merge_table(df.filter(f"NOT coalesce({_LACKING[name]}, false)"), incoming, name, None, None, False)
    return _keyed(merged, "inserted")


@query(
    "A6_catalogue_json",
    """WITH latest AS (SELECT video_id, status, progress_percent FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS r FROM jobs) WHERE r = 1)
    SELECT v.id, CAST(json_object('id', v.id, 'creation_time', v.creation_text, 'creation_date', substr(v.creation_text, 1, 10), 'device', CASE WHEN trim(coalesce(v.device_model, '')) = '' THEN '미상' ELSE trim(v.device_model) END,
      'duration_seconds', v.duration_seconds, 'status', coalesce(l.status, 'untracked'), 'progress_percent', l.progress_percent, 'path', v.original_path) AS VARCHAR) AS item FROM videos v LEFT JOIN latest l ON v.id = l.video_id""",
)
def a6(spark, sf):
    return R.catalogue_json(C.catalogue(V.videos(spark, sf), V.jobs(spark, sf)))


@query(
    "A6_catalogue_csv",
    """WITH latest AS (SELECT video_id, status, progress_percent FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS r FROM jobs) WHERE r = 1)
    SELECT v.id, concat_ws(',', v.id, substr(v.creation_text, 1, 10), v.creation_text, CASE WHEN trim(coalesce(v.device_model, '')) = '' THEN '미상' ELSE trim(v.device_model) END,
      coalesce(CAST(v.duration_seconds AS VARCHAR), ''), coalesce(l.status, 'untracked'), coalesce(CAST(l.progress_percent AS VARCHAR), ''), v.original_path) AS line FROM videos v LEFT JOIN latest l ON v.id = l.video_id""",
)
def a6c(spark, sf):
    return R.catalogue_csv(C.catalogue(V.videos(spark, sf), V.jobs(spark, sf)))


@query(
    "A7_project_list",
    """SELECT p.id, CAST(json_object('id', p.id, 'name', p.name, 'description', p.description, 'merge_job_count', count(l.merge_job_id), 'total_duration_seconds', coalesce(sum(floor(m.total_duration_seconds)), 0)::DOUBLE,
      'uploaded_count', count(m.youtube_id)) AS VARCHAR) AS item FROM projects p LEFT JOIN links l ON l.project_id = p.id LEFT JOIN merges m ON m.id = l.merge_job_id GROUP BY p.id, p.name, p.description""",
)
def a7(spark, sf):
    # whole seconds, so that the sums do not depend on the order of rows
    merges = V.merges(spark, sf).withColumn("total_duration_seconds", F.floor("total_duration_seconds").cast("double"))
    return R.project_list_json(V.projects(spark, sf), V.links(spark, sf), merges)


@query(
    "A7_project_detail",
    """WITH j AS (SELECT l.project_id, l.merge_job_id, m.*, coalesce(date, '날짜 미상') AS day, (row_number() OVER (PARTITION BY project_id ORDER BY id) - 1) // 5 AS page,
      (row_number() OVER (PARTITION BY project_id ORDER BY coalesce(date, '날짜 미상'), id) - 1) // 5 AS day_page FROM links l JOIN merges m ON m.id = l.merge_job_id)
    SELECT p.id AS project_id, 'summary' AS section, 0 AS part, CAST(json_object('id', p.id, 'name', p.name, 'total_count', count(j.id), 'uploaded_count', count(j.youtube_id), 'total_size_bytes', CAST(coalesce(sum(j.total_size_bytes), 0) AS BIGINT)) AS VARCHAR) AS body
      FROM projects p LEFT JOIN j ON j.project_id = p.id GROUP BY p.id, p.name
    UNION ALL SELECT project_id, 'merge_jobs', page, '[' || string_agg(CAST(json_object('id', id, 'title', title, 'date', date, 'size_bytes', total_size_bytes, 'youtube_id', youtube_id, 'output_path', output_path) AS VARCHAR), ',' ORDER BY id) || ']' FROM j GROUP BY 1, 3
    UNION ALL SELECT project_id, 'date_groups', part, '{' || string_agg('"' || date || '":' || ids, ',' ORDER BY date) || '}' FROM
      (SELECT project_id, day AS date, day_page AS part, '[' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) || ']' AS ids FROM j GROUP BY 1, 2, 3) GROUP BY 1, 3""",
)
def a7d(spark, sf):
    return R.project_detail_json(V.projects(spark, sf), V.links(spark, sf), V.merges(spark, sf), per_document=5)


# ----------------------------------------------------------------------- G
@query(
    "G1s_backup_targets",
    """WITH t AS (SELECT id AS merge_job_id, output_path AS source_path, 'output' AS source_type FROM merges UNION ALL SELECT l_orderkey, '/out/' || l_orderkey || '_' || l_partkey || '.mp4', 'split' FROM lineitem
      UNION ALL SELECT id, '/lapse/' || id || '.mp4', 'timelapse' FROM merges UNION ALL SELECT id, '/media/' || (id % 2000) || '.mp4', 'original' FROM merges),
    inv AS (SELECT DISTINCT output_path AS path FROM merges WHERE status = 'completed' UNION SELECT source_path FROM backup_history WHERE success UNION SELECT original_path FROM archive_history WHERE operation = 'move')
    SELECT merge_job_id, source_path, source_type, source_path IN (SELECT path FROM inv) AS present FROM t""",
)
def g1(spark, sf):
    merges = V.merges(spark, sf)
    backups = V.backup_history(spark, sf)
    outputs = merges.select(c("id").alias("merge_job_id"), c("output_path").alias("path"))
    splits = backups.select("merge_job_id", c("source_path").alias("path"))
    lapses = merges.select(c("id").alias("merge_job_id"), F.concat(F.lit("/lapse/"), "id", F.lit(".mp4")).alias("path"))
    originals = merges.select(
        c("id").alias("merge_job_id"), F.concat(F.lit("/media/"), c("id") % 2000, F.lit(".mp4")).alias("path")
    )
    inventory = (
        merges.filter("status = 'completed'").select(c("output_path").alias("path"))
        .union(backups.filter("success").select("source_path"))
        .union(V.archive_history(spark, sf).filter("operation = 'move'").select("original_path"))
    )
    return K.backup_targets(outputs, splits, lapses, inventory, originals)


def _json_sql():
    parts = []
    for table, (view, _) in _COLUMNS.items():
        have = dict(_fields(table))
        pairs = []
        for column in (f.split()[0] for f in TABLES[table].split(", ")):
            value = "NULL" if column not in have else f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f')" if have[column] == "t" else column
            pairs.append(f"'{column}', {value}")
        parts.append(f"SELECT '{table}' AS tbl, CAST(json_object({', '.join(pairs)}) AS VARCHAR) AS row FROM {view}")
    return " UNION ALL ".join(parts)


@query("G2s_snapshot_rows", _json_sql())
def g2(spark, sf):
    """Every column of every row of every table."""
    return SNAP.snapshot_rows(_tables(spark, sf))


@query(
    "G3s_target_union",
    f"""SELECT path, {ts('min(t)')} AS creation_time, max(size_bytes) AS size_bytes FROM (SELECT original_path AS path, creation_time AS t, size_bytes FROM videos
    UNION ALL SELECT original_path, archived_at, 1 FROM archive_history UNION ALL SELECT output_path, created_at, total_size_bytes FROM merges) GROUP BY 1""",
)
def g3(spark, sf):
    cols = ["path", "creation_time", "size_bytes"]
    return INV.union_targets(
        V.videos(spark, sf).select("original_path", "creation_time", "size_bytes").toDF(*cols),
        V.archive_history(spark, sf).select("original_path", "archived_at", F.lit(1).cast("bigint")).toDF(*cols),
        V.merges(spark, sf).select("output_path", "created_at", "total_size_bytes").toDF(*cols),
    )


# ----------------------------------------------------------------------- K
_INCOMING = """SELECT CASE WHEN l_partkey % 3 = 0 THEN '/new/' || l_partkey || '.mp4' ELSE v.original_path END AS original_path, l_shipdate AS creation_time FROM lineitem JOIN videos v ON v.id = l_partkey"""


@query(
    "K1_register_videos",
    f"""WITH i AS (SELECT original_path, min(creation_time) AS creation_time FROM ({_INCOMING}) GROUP BY 1),
    n AS (SELECT i.*, v.id AS vid FROM i LEFT JOIN videos v USING (original_path)), x AS (SELECT *, row_number() OVER (PARTITION BY vid IS NULL ORDER BY creation_time, original_path) AS r FROM n)
    SELECT original_path, {ts('creation_time')} AS creation_time, coalesce(vid, (SELECT max(id) FROM videos) + r) AS id, vid IS NULL AS is_new FROM x""",
)
def k1(spark, sf):
    videos = V.videos(spark, sf)
    paths = videos.select(c("id").alias("l_partkey"), c("original_path").alias("p"))
    incoming = V.load(spark, sf, "lineitem").select("l_partkey", "l_shipdate").join(paths, "l_partkey").select(
        F.when(c("l_partkey") % 3 == 0, F.concat(F.lit("/new/"), "l_partkey", F.lit(".mp4"))).otherwise(c("p")).alias("original_path"),
        c("l_shipdate").alias("creation_time"),
    )
    return K.register_videos(videos, incoming)


# events on the jobs: one per lineitem, several per job
_EVENTS_SQL = """ev AS (SELECT l_partkey * 5 AS job_id, l_orderkey * 8 + l_linenumber + l_suppkey * 10000000 AS seq, CASE l_linenumber WHEN 1 THEN 'processing' WHEN 2 THEN 'progress' WHEN 3 THEN 'finish' WHEN 4 THEN 'fail' WHEN 5 THEN 'reset'
    WHEN 6 THEN 'merged' ELSE 'explode' END AS action, l_shipdate AS at_time, CASE l_linenumber WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 3 THEN '/work/done_' || l_partkey WHEN 4 THEN 'err ' || l_suppkey END AS detail FROM lineitem)"""


def _job_events(spark, sf):
    return V.load(spark, sf, "lineitem").selectExpr(
        "l_partkey * 5 AS job_id",
        "l_orderkey * 8 + l_linenumber + l_suppkey * 10000000 AS seq",
        "element_at(array('processing', 'progress', 'finish', 'fail', 'reset', 'merged', 'explode'), l_linenumber) AS action",
        "l_shipdate AS at",
        "CASE l_linenumber WHEN 2 THEN cast(cast(l_quantity AS int) AS string) WHEN 3 THEN concat('/work/done_', l_partkey) WHEN 4 THEN concat('err ', l_suppkey) END AS detail",
    )


def _last(column: str, value: str, actions: str) -> str:
    return f"""CASE WHEN count(*) FILTER (action IN ({actions})) > 0 THEN list(CAST({value} AS VARCHAR) ORDER BY seq DESC) FILTER (action IN ({actions})) END AS {column}"""


@query(
    "K2_job_events",
    f"""WITH {_EVENTS_SQL}, f AS (SELECT job_id, {_last('st', "CASE action WHEN 'finish' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'reset' THEN 'pending' ELSE action END", "'processing','finish','fail','reset','merged'")},
      {_last('pr', "CASE action WHEN 'finish' THEN '100' WHEN 'reset' THEN '0' ELSE detail END", "'progress','finish','reset'")}, {_last('tf', 'detail', "'finish'")},
      {_last('er', "CASE action WHEN 'fail' THEN detail END", "'fail','reset'")}, {_last('sa', "CASE action WHEN 'processing' THEN " + ts('at_time') + " END", "'processing','reset'")},
      {_last('ca', "CASE WHEN action IN ('finish', 'fail') THEN " + ts('at_time') + " END", "'finish','fail','reset'")} FROM ev GROUP BY 1)
    SELECT j.id, CASE WHEN st IS NULL THEN j.status ELSE st[1] END AS status, CASE WHEN pr IS NULL THEN j.progress_percent ELSE CAST(pr[1] AS INTEGER) END AS progress_percent,
      CASE WHEN tf IS NULL THEN j.temp_file_path ELSE tf[1] END AS temp_file_path, CASE WHEN er IS NULL THEN j.error_message ELSE er[1] END AS error_message,
      CASE WHEN sa IS NULL THEN {ts('j.started_at')} ELSE sa[1] END AS started_at, CASE WHEN ca IS NULL THEN {ts('j.completed_at')} ELSE ca[1] END AS completed_at FROM jobs j LEFT JOIN f ON f.job_id = j.id""",
)
def k2(spark, sf):
    out = K.apply_job_events(V.jobs(spark, sf), _job_events(spark, sf))
    return out.select("id", "status", "progress_percent", "temp_file_path", "error_message", "started_at", "completed_at")


@query("K2_illegal_events", f"WITH {_EVENTS_SQL} SELECT action, count(*) AS cnt FROM ev WHERE action = 'explode' GROUP BY 1")
def k2i(spark, sf):
    return K.illegal_events(_job_events(spark, sf)).groupBy("action").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "K3_get_or_create_jobs",
    """WITH w AS (SELECT DISTINCT id AS video_id FROM videos), o AS (SELECT video_id, id, status, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS r FROM jobs WHERE status IN ('pending', 'processing')),
    x AS (SELECT w.video_id, o.id, o.status FROM w LEFT JOIN o ON o.video_id = w.video_id AND r = 1), n AS (SELECT *, row_number() OVER (PARTITION BY id IS NULL ORDER BY video_id) AS k FROM x)
    SELECT video_id, coalesce(id, (SELECT max(id) FROM jobs) + k) AS id, coalesce(status, 'pending') AS status, id IS NULL AS created FROM n""",
)
def k3(spark, sf):
    return K.get_or_create_jobs(V.jobs(spark, sf), V.videos(spark, sf).select(c("id").alias("video_id")))


@query(
    "K4_resume_plan",
    """WITH d AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS r FROM jobs WHERE status = 'completed' AND temp_file_path IS NOT NULL)
    SELECT v.id AS video_id, d.id AS job_id, d.temp_file_path, CASE WHEN d.id IS NULL THEN 'process' WHEN d.id % 2 = 0 THEN 'skip' ELSE 'mark_merged_and_process' END AS action
    FROM videos v LEFT JOIN d ON d.video_id = v.id AND r = 1""",
)
def k4(spark, sf):
    jobs = V.jobs(spark, sf)
    inventory = jobs.filter("id % 2 = 0").select(c("temp_file_path").alias("path"))
    return K.resume_plan(V.videos(spark, sf), jobs, inventory)


@query(
    "K5_mark_merged",
    """WITH s AS (SELECT DISTINCT o_custkey AS video_id FROM orders WHERE o_orderpriority LIKE '1-%')
    SELECT id, CASE WHEN status = 'completed' AND video_id IN (SELECT video_id FROM s) THEN 'merged' ELSE status END AS status, status = 'completed' AND video_id IN (SELECT video_id FROM s) AS changed FROM jobs""",
)
def k5(spark, sf):
    ids = V.load(spark, sf, "orders").filter("o_orderpriority LIKE '1-%'").select(c("o_custkey").alias("video_id"))
    return K.mark_merged(V.jobs(spark, sf), ids).select("id", "status", "changed")


@query(
    "K6_reset_for_retry",
    f"""SELECT id, CASE WHEN f THEN 'pending' ELSE status END AS status, CASE WHEN f THEN 0 ELSE progress_percent END AS progress_percent, CASE WHEN f THEN NULL ELSE error_message END AS error_message,
    CASE WHEN NOT f THEN {ts('started_at')} END AS started_at, CASE WHEN NOT f THEN {ts('completed_at')} END AS completed_at FROM (SELECT *, status = 'failed' AS f FROM jobs)""",
)
def k6(spark, sf):
    out = K.reset_for_retry(V.jobs(spark, sf), c("status") == "failed")
    return out.select("id", "status", "progress_percent", "error_message", "started_at", "completed_at")


@query(
    "K7_cascade_delete",
    """WITH dv AS (SELECT id FROM videos WHERE device_model IS NULL), dm AS (SELECT id FROM merges WHERE status = 'failed'), dp AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0) """
    + _keyed_sql(
        {
            "projects": "projects WHERE id NOT IN (SELECT id FROM dp)",
            "videos": "videos WHERE id NOT IN (SELECT id FROM dv)",
            "transcoding_jobs": "jobs WHERE video_id NOT IN (SELECT id FROM dv)",
            "merge_jobs": "merges WHERE id NOT IN (SELECT id FROM dm)",
            "split_jobs": "splits WHERE merge_job_id NOT IN (SELECT id FROM dm)",
            "archive_history": "archive_history WHERE video_id NOT IN (SELECT id FROM dv)",
            "backup_history": "backup_history WHERE merge_job_id NOT IN (SELECT id FROM dm)",
            "project_merge_jobs": "links WHERE merge_job_id NOT IN (SELECT id FROM dm) AND project_id NOT IN (SELECT id FROM dp)",
        }
    ),
)
def k7(spark, sf):
    tables = _tables(spark, sf)
    return _keyed(
        K.cascade_delete(
            tables,
            many=True,
            videos=tables["videos"].filter("device_model IS NULL").select("id"),
            merge_jobs=tables["merge_jobs"].filter("status = 'failed'").select("id"),
            projects=V.load(spark, sf, "customer").filter("c_acctbal < 0").select(c("c_custkey").alias("id")),
        )
    )


@query(
    "K8_reset_build",
    """WITH p AS (SELECT DISTINCT output_path FROM merges WHERE youtube_id IS NOT NULL), hit AS (SELECT * FROM merges WHERE output_path IN (SELECT output_path FROM p)),
    nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY output_path ORDER BY created_at DESC, id DESC) AS r FROM hit) WHERE r = 1),
    dv AS (SELECT DISTINCT unnest(CAST(json_extract(video_ids, '$') AS BIGINT[])) AS id FROM nw WHERE json_valid(video_ids)) """
    + _keyed_sql(
        {
            "videos": "videos WHERE id NOT IN (SELECT id FROM dv)",
            "transcoding_jobs": "jobs WHERE video_id NOT IN (SELECT id FROM dv)",
            "merge_jobs": "merges WHERE id NOT IN (SELECT id FROM hit)",
            "split_jobs": "splits WHERE merge_job_id NOT IN (SELECT id FROM hit)",
            "archive_history": "archive_history WHERE video_id NOT IN (SELECT id FROM dv)",
            "backup_history": "backup_history WHERE merge_job_id NOT IN (SELECT id FROM hit)",
            "project_merge_jobs": "links WHERE merge_job_id NOT IN (SELECT id FROM hit)",
        }
    ),
)
def k8(spark, sf):
    tables = _tables(spark, sf)
    paths = tables["merge_jobs"].filter("youtube_id IS NOT NULL").select("output_path")
    return _keyed(K.reset_build(tables, paths, many=True))


@query(
    "K9_uploads",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 3 = 0 THEN 'up' || id WHEN id % 3 = 1 THEN NULL ELSE youtube_id END AS youtube_id FROM merges""",
)
def k9(spark, sf):
    merges = V.merges(spark, sf)
    uploads = merges.filter("id % 3 <> 2").select(
        c("id").alias("merge_job_id"), F.when(c("id") % 3 == 0, F.concat(F.lit("up"), "id")).alias("youtube_id"), F.lit(1).alias("order_no")
    )
    # some merges are uploaded and taken back in one go
    again = merges.filter("id % 6 = 0").select(
        c("id").alias("merge_job_id"), F.lit(None).cast("string").alias("youtube_id"), F.lit(2).alias("order_no")
    )
    uploads = again.unionByName(uploads)
    return K.set_uploads(merges, uploads).select("id", "status", "youtube_id")


@query(
    "K9_split_uploads",
    """SELECT id, CASE WHEN split_criterion = 'duration' THEN CASE WHEN youtube_ids IS NULL OR NOT json_valid(youtube_ids) THEN '["n' || id || '"' || t || ']' ELSE replace(youtube_ids, ']', ',"n' || id || '"' || t || ']') END ELSE youtube_ids END AS youtube_ids FROM (SELECT *, CASE WHEN id % 2 = 0 THEN ',"a' || id || '"' ELSE '' END AS t FROM splits)""",
)
def k9s(spark, sf):
    splits = V.splits(spark, sf)
    uploads = splits.filter("split_criterion = 'duration'").select(
        c("id").alias("split_id"), F.concat(F.lit("n"), "id").alias("youtube_id"), F.lit(1).alias("order_no")
    )
    # parts with even numbers have two uploads
    second = uploads.filter("split_id % 2 = 0").select(
        "split_id", F.concat(F.lit("a"), "split_id").alias("youtube_id"), F.lit(2).alias("order_no")
    )
    uploads = second.unionByName(uploads)
    return K.append_split_uploads(splits, uploads).select("id", "youtube_ids")


# what is replaced by what in the paths of each table
_MOVED = {
    "videos": ("/media", "/vol/new"), "transcoding_jobs": ("/work", "/w/work"), "merge_jobs": ("/out", "/o"),
    "split_jobs": ("/out", "/vol/out"), "archive_history": ("/m", "/m/m"), "backup_history": ("/out/", "/b/"),
}


def _moved_sql():
    sources = {t: None for t in _COLUMNS}
    for table, (old, new) in _MOVED.items():
        changed = [
            f"CASE WHEN json_valid({x}) THEN replace({x}, '{old}', '{new}') ELSE {x} END AS {x}" if x == "output_files" else f"replace({x}, '{old}', '{new}') AS {x}"
            for x in PATH_COLUMNS[table]
        ]
        sources[table] = f"(SELECT * REPLACE ({', '.join(changed)}) FROM {_COLUMNS[table][0]})"
    return _keyed_sql(sources)


@query("K10_rewrite_paths", _moved_sql())
def k10(spark, sf):
    tables = _tables(spark, sf)
    return _keyed({name: K.rewrite_paths(tables[name], name, old, new) for name, (old, new) in _MOVED.items()})


# incoming videos: known ids with known or new paths, and new ids with known or new paths
_UPSERT = """inc AS (SELECT id + CASE WHEN id % 4 >= 2 THEN 100000000 ELSE 0 END AS id, CASE WHEN id % 2 = 0 THEN original_path ELSE '/inc/' || (id // 3) END AS original_path FROM videos)"""


def _incoming_videos(videos):
    return videos.select(
        (c("id") + F.when(c("id") % 4 >= 2, 100000000).otherwise(0)).alias("id"),
        F.when(c("id") % 2 == 0, c("original_path")).otherwise(F.concat(F.lit("/inc/"), F.expr("id div 3"))).alias("original_path"),
    )


@query(
    "K11_upsert_ignore",
    f"""WITH {_UPSERT}, f AS (SELECT * FROM inc WHERE id NOT IN (SELECT id FROM videos) AND original_path NOT IN (SELECT original_path FROM videos)),
    k AS (SELECT *, row_number() OVER (PARTITION BY original_path ORDER BY id) AS r FROM f)
    SELECT id, original_path, FALSE AS inserted FROM videos UNION ALL SELECT id, original_path, TRUE FROM k WHERE r = 1""",
)
def k11(spark, sf):
    videos = V.videos(spark, sf).select("id", "original_path")
    return K.upsert(videos, _incoming_videos(videos), (("id",), ("original_path",)), ["id"])


@query(
    "K11_upsert_replace",
    f"""WITH {_UPSERT}, a AS (SELECT id, original_path, FALSE AS inserted, -1 AS o FROM videos UNION ALL SELECT id, original_path, TRUE, id FROM inc),
    m AS (SELECT *, max(o) OVER (PARTITION BY id) AS m1, max(o) OVER (PARTITION BY original_path) AS m2 FROM a) SELECT id, original_path, inserted FROM m WHERE o = m1 AND o = m2""",
)
def k11r(spark, sf):
    videos = V.videos(spark, sf).select("id", "original_path")
    return K.upsert(videos, _incoming_videos(videos), (("id",), ("original_path",)), ["id"], replace=True)


def _dated_projects(spark, sf):
    return V.projects(spark, sf).select(
        "id", "name", F.lit("1990-01-01").alias("date_range_start"), F.lit("1990-01-02").alias("date_range_end"), "updated_at"
    )


def _link_sql(unlink: bool) -> str:
    pairs = "pairs AS (SELECT DISTINCT l_suppkey AS project_id, l_orderkey AS merge_job_id FROM lineitem)"
    combined = (
        "nl AS (SELECT project_id, merge_job_id FROM links EXCEPT SELECT * FROM pairs)"
        if unlink
        else "nl AS (SELECT project_id, merge_job_id FROM links UNION SELECT * FROM pairs)"
    )
    return f"""WITH {pairs}, {combined}, d AS (SELECT nl.project_id AS id, min(date) AS lo, max(date) AS hi, count(*) AS n FROM nl JOIN merges m ON m.id = nl.merge_job_id GROUP BY 1)
    SELECT p.id, CASE WHEN t THEN d.lo ELSE '1990-01-01' END AS date_range_start, CASE WHEN t THEN d.hi ELSE '1990-01-02' END AS date_range_end, CASE WHEN t THEN '2025-01-01 00:00:00.000000' ELSE {ts('p.updated_at')} END AS updated_at, coalesce(d.n, 0) AS links
    FROM (SELECT *, id IN (SELECT project_id FROM pairs) AS t FROM projects) p LEFT JOIN d ON d.id = p.id"""


def _linked(spark, sf, unlink):
    pairs = V.load(spark, sf, "lineitem").select(c("l_suppkey").alias("project_id"), c("l_orderkey").alias("merge_job_id"))
    projects, links = K.link_merges(_dated_projects(spark, sf), V.links(spark, sf), V.merges(spark, sf), pairs, _now(), unlink)
    counts = links.groupBy(c("project_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    return projects.join(counts, "id", "left").select(
        "id", "date_range_start", "date_range_end", "updated_at", F.coalesce("links", F.lit(0)).alias("links")
    )


@query("K12_link_merges", _link_sql(False))
def k12(spark, sf):
    return _linked(spark, sf, False)


@query("K12_unlink_merges", _link_sql(True))
def k12u(spark, sf):
    return _linked(spark, sf, True)


@query(
    "K12_update_projects",
    """WITH c AS (SELECT o_custkey AS id, max_by(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 = 0) AS d, max_by('PL' || o_orderkey, o_orderkey) FILTER (o_orderkey % 5 = 0) AS l FROM orders GROUP BY 1)
    SELECT p.id, coalesce(d, description) AS description, l AS playlist_id, d IS NOT NULL OR l IS NOT NULL AS changed FROM projects p LEFT JOIN c USING (id)""",
)
def k12p(spark, sf):
    changes = V.load(spark, sf, "orders").selectExpr(
        "o_custkey AS id",
        "o_orderkey AS order_no",
        "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS description",
        "CASE WHEN o_orderkey % 5 = 0 THEN concat('PL', o_orderkey) END AS playlist_id",
    )
    projects = V.projects(spark, sf).withColumn("playlist_id", F.lit(None).cast("string"))
    out = K.update_projects(projects, changes, F.expr("timestamp_ntz'2030-01-01 00:00:00'"))
    return out.select("id", "description", "playlist_id", (F.year("updated_at") == 2030).alias("changed"))


@query(
    "K12_get_or_create_project",
    """WITH w AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE s_name END AS name FROM supplier), x AS (SELECT w.name, p.id FROM w LEFT JOIN projects p USING (name)),
    n AS (SELECT *, row_number() OVER (PARTITION BY id IS NULL ORDER BY name) AS k FROM x) SELECT name, coalesce(id, (SELECT max(id) FROM projects) + k) AS id, id IS NULL AS created FROM n""",
)
def k12g(spark, sf):
    names = V.load(spark, sf, "supplier").selectExpr(
        "CASE WHEN s_suppkey % 2 = 0 THEN concat('Customer#', lpad(s_suppkey, 9, '0')) ELSE s_name END AS name"
    )
    return K.get_or_create_projects(V.projects(spark, sf), names)


def _archive_request(spark, sf):
    # many files of few names into few folders, some with a number of their own
    return V.load(spark, sf, "events").selectExpr(
        "event_id AS order_no",
        "user_id AS video_id",
        "concat('/media/', event_id, '/x.mp4') AS original_path",
        "concat('/vault/', user_id % 10) AS dest",
        "CASE WHEN event_id % 5 = 0 THEN concat('clip_', event_id % 4 + 1, '.mp4') WHEN event_id % 5 = 1 THEN 'clip_1_1.mp4' ELSE 'clip.mp4' END AS name",
        "event_type <> 'error' AS present",
    )


@query("E11_archive_numbers")
def e11(spark, sf):
    existing = V.load(spark, sf, "supplier").selectExpr(
        "concat('/vault/', s_suppkey % 10) AS dest", "concat('clip_', s_suppkey % 13, '.mp4') AS name"
    )
    return K.number_destinations(_archive_request(spark, sf).filter("present"), existing)


@query(
    "E11_archive_numbers_plain",
    """SELECT event_id AS order_no, '/vault/' || (user_id % 10) AS dest, event_type || '.mp4' AS name, CASE WHEN n = 1 THEN event_type || '.mp4' ELSE event_type || '_' || (n - 1) || '.mp4' END AS final_name
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY event_id) AS n FROM events)""",
)
def e11p(spark, sf):
    files = V.load(spark, sf, "events").selectExpr(
        "event_id AS order_no", "concat('/vault/', user_id % 10) AS dest", "concat(event_type, '.mp4') AS name"
    )
    return K.number_destinations(files, files.select("dest", "name").limit(0))


@query(
    "K13_archive_outcomes",
    """SELECT policy, outcome, count(*) AS cnt FROM (SELECT 'keep' AS policy, 'kept' AS outcome FROM events UNION ALL SELECT 'delete', CASE WHEN event_type <> 'error' THEN 'deleted' ELSE 'absent' END FROM events
    UNION ALL SELECT 'move', CASE WHEN event_type <> 'error' THEN 'moved' ELSE 'failed' END FROM events) GROUP BY 1, 2""",
)
def k13(spark, sf):
    files = _archive_request(spark, sf)
    out = None
    for policy in ("keep", "delete", "move"):
        one = K.archive_files(files, policy, files.select("dest", "name").limit(0)).withColumn("policy", F.lit(policy))
        counted = one.groupBy("policy", "outcome").agg(F.count(F.lit(1)).alias("cnt"))
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "K13_archive_history",
    """SELECT user_id AS video_id, 'delete' AS operation, '/media/' || event_id || '/x.mp4' AS original_path, CAST(NULL AS VARCHAR) AS destination_path, '2025-01-01 00:00:00.000000' AS archived_at FROM events WHERE event_type <> 'error'""",
)
def k13h(spark, sf):
    return K.archive_history_rows(K.archive_files(_archive_request(spark, sf), "delete"), _now())


@query(
    "K14_append_backups",
    f"""WITH r AS (SELECT id AS merge_job_id, output_path AS source_path, status = 'completed' AS success FROM merges), n AS (SELECT *, row_number() OVER (ORDER BY merge_job_id, source_path) AS k FROM r)
    SELECT id, merge_job_id, source_path, success, {ts('backed_up_at')} AS backed_up_at FROM backup_history UNION ALL SELECT (SELECT max(id) FROM backup_history) + k, merge_job_id, source_path, success, '2025-01-01 00:00:00.000000' FROM n""",
)
def k14(spark, sf):
    results = V.merges(spark, sf).select(
        c("id").alias("merge_job_id"),
        c("output_path").alias("source_path"),
        F.lit("nas").alias("remote"),
        F.lit("output").alias("source_type"),
        (c("status") == "completed").alias("success"),
        F.lit(None).cast("string").alias("error_message"),
    )
    out = K.append_backups(V.backup_history(spark, sf), results, _now())
    return out.orderBy("merge_job_id", F.desc("backed_up_at"), F.desc("id")).select(
        "id", "merge_job_id", "source_path", "success", "backed_up_at"
    )


@query("K15_schema_upgrade", "SELECT id, original_path, duration_seconds, CAST(NULL AS VARCHAR) AS metadata_json, CAST(NULL AS VARCHAR) AS created_at FROM videos")
def k15(spark, sf):
    old = V.videos(spark, sf).select("id", "original_path", "creation_time", "duration_seconds", "device_model")
    return K.conform(old, "videos").select("id", "original_path", "duration_seconds", "metadata_json", "created_at")


@query(
    "K16_merge_records",
    """WITH t AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY merge_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS s, count(*) OVER (PARTITION BY merge_id) AS n, sum(duration) OVER (PARTITION BY merge_id) AS total FROM clips)
    SELECT merge_id, (position - 1) // 1000 AS part, any_value(n) AS clip_count, any_value(total) AS total_duration, '[' || string_agg(CAST(json_object('name', name, 'duration', duration, 'start', s, 'end', s + duration, 'device', device, 'shot_time', shot_time) AS VARCHAR), ',' ORDER BY position) || ']' AS clips_info_json,
      '[' || string_agg(video_id, ',' ORDER BY position) || ']' AS video_ids FROM t GROUP BY 1, 2""",
)
def k16(spark, sf):
    return K.merge_records(V.clips(spark, sf), short=True)


@query(
    "K16_merge_jobs",
    f"""WITH {runs_sql()}, t AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY merge_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS s, sum(duration) OVER (PARTITION BY merge_id) AS total FROM clips),
    j AS (SELECT merge_id, any_value(total) AS total, '[' || string_agg(CAST(json_object('name', name, 'duration', duration, 'start', s, 'end', s + duration, 'device', device, 'shot_time', shot_time) AS VARCHAR), ',' ORDER BY position) || ']' AS clips_info_json,
      '[' || string_agg(video_id, ',' ORDER BY position) || ']' AS video_ids FROM t GROUP BY 1),
    h AS (SELECT merge_id, string_agg({clock_sql('start_s')} || ' ' || replace(name, '.mp4', ''), chr(10) ORDER BY run) AS body FROM laid GROUP BY 1),
    dev AS (SELECT merge_id, string_agg(device, ', ' ORDER BY pos) AS devices FROM (SELECT merge_id, device, min(position) AS pos FROM clips WHERE coalesce(device, '') <> '' GROUP BY 1, 2) GROUP BY 1)
    SELECT j.merge_id, 0 AS part, output_path, j.video_ids, CASE m.id % 4 WHEN 0 THEN 'Trip ' || (m.id % 50) WHEN 1 THEN 'day' || (m.id % 9) WHEN 2 THEN regexp_extract(output_path, '([^/]*)[.]mp4$', 1) END AS title,
      strftime(m.created_at, '%Y-%m-%d') AS date, total AS total_duration_seconds, CASE WHEN m.id % 6 = 0 THEN 0 ELSE m.total_size_bytes END AS total_size_bytes, clips_info_json,
      h.body || CASE WHEN devices IS NULL THEN '' ELSE chr(10) || chr(10) || '이 영상은 ' || devices || '로 촬영됨' END AS summary_markdown
    FROM j JOIN merges m ON m.id = j.merge_id JOIN h ON h.merge_id = j.merge_id LEFT JOIN dev ON dev.merge_id = j.merge_id""",
)
def k16m(spark, sf):
    """Folders, files and nameless folders as targets; some outputs without a size."""
    outputs = V.merges(spark, sf).selectExpr(
        "id AS merge_id",
        "output_path",
        "CASE id % 4 WHEN 0 THEN concat('/m/Trip ', id % 50) WHEN 1 THEN concat('/m/day', id % 9, '/a.mov') WHEN 2 THEN 'a.mov' END AS target",
        "CASE WHEN id % 6 > 0 THEN total_size_bytes END AS size_bytes",
        "date_format(created_at, 'yyyy-MM-dd') AS date",
    )
    return I.merge_jobs(outputs, V.clips(spark, sf), short=True)


@query(
    "K17_split_plan",
    """WITH m AS (SELECT id, total_duration_seconds AS t, CASE WHEN id % 10 = 0 THEN 0 ELSE 8000000 END AS br, CASE WHEN id % 3 = 0 THEN 3600 WHEN id % 7 = 0 THEN 5400 END AS d, CASE WHEN id % 2 = 0 THEN 2147483648 END AS sz FROM merges),
    s AS (SELECT *, coalesce(d, CASE WHEN br > 0 THEN sz * 8 // br END) AS sec, CASE WHEN d IS NULL AND sz IS NULL THEN 'no split criterion' WHEN d IS NULL AND br = 0 THEN 'bitrate unknown' END AS reason FROM m),
    p AS (SELECT id, t, sec, reason, unnest(CASE WHEN reason IS NULL THEN range(1, CAST(ceil(t / sec) AS BIGINT) + 1) ELSE [NULL] END) AS part_no FROM s)
    SELECT id, part_no, sec AS seconds, CAST((part_no - 1) * sec AS DOUBLE) AS start_s, round(least(part_no * sec, t), 6) AS end_s, reason FROM p""",
)
def k17(spark, sf):
    rows = V.merges(spark, sf).selectExpr(
        "id",
        "total_duration_seconds AS total_s",
        "CASE WHEN id % 10 = 0 THEN 0 ELSE 8000000 END AS bitrate",
        "CASE WHEN id % 3 = 0 THEN '1h' WHEN id % 7 = 0 THEN '90m' END AS duration_spec",
        "CASE WHEN id % 2 = 0 THEN '2G' END AS size_spec",
    )
    return K.split_plan(rows)
