"""Batch twins of the streaming jobs; the streams themselves are run by the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliplake.operators import state as K
from cliplake.operators import stats as D
from cliplake.plans import views as V
from cliplake.plans.queries_state import _EVENTS_SQL, _job_events, _last
from cliplake.plans.registry import query, ts
from cliplake.streaming import progress as P
from cliplake.streaming import routing as R
from cliplake.streaming import watch as W

c = F.col

_WATCH_PATH = "'/in/' || user_id || CASE event_id % 6 WHEN 0 THEN '/.hidden.mp4' WHEN 1 THEN '/notes.txt' WHEN 2 THEN '/A.MP4' WHEN 3 THEN '/b.mov' ELSE '/c.mkv' END"


@query(
    "L1_watch_ingest",
    f"""SELECT path, size, {ts('min(ts)')} AS at FROM (SELECT CASE WHEN event_type = 'signup' THEN '/moved/' || (event_id % 100) || '.mp4' ELSE {_WATCH_PATH} END AS path, CAST(value AS BIGINT) % 7 AS size, ts
      FROM (SELECT * REPLACE (floor(value) AS value) FROM events) WHERE event_id % 11 > 0) WHERE path NOT LIKE '%/.%' AND path NOT LIKE '%.txt' GROUP BY 1, 2""",
)
def l1(spark, sf):
    events = V.load(spark, sf, "events").selectExpr(
        "CASE WHEN event_type = 'signup' THEN 'moved' WHEN event_type = 'click' THEN 'modified' ELSE 'created' END AS kind",
        "concat('/in/', user_id, element_at(array('/.hidden.mp4', '/notes.txt', '/A.MP4', '/b.mov', '/c.mkv', '/c.mkv'), cast(event_id % 6 + 1 AS int))) AS path",
        "concat('/moved/', event_id % 100, '.mp4') AS dest_path",
        "event_id % 11 = 0 AS is_directory",
        "cast(floor(value) AS bigint) % 7 AS size",
        "ts AS at",
    )
    return W.watch_batch(events)


def _observations(spark, sf):
    return V.load(spark, sf, "events").selectExpr(
        "concat('/in/', user_id, '.mp4') AS path",
        "event_id AS seq",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(floor(value / 15) AS bigint) END AS size",
        "ts AS at",
    )


@query(
    "L2_stability_gate",
    f"""WITH o AS (SELECT '/in/' || user_id || '.mp4' AS path, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value / 15) AS BIGINT) END AS size, ts FROM events),
    f AS (SELECT *, CASE WHEN size = lag(size) OVER w THEN 0 ELSE 1 END AS s FROM o WINDOW w AS (PARTITION BY path ORDER BY ts, seq)), g AS (SELECT *, sum(s) OVER (PARTITION BY path ORDER BY ts, seq) AS run FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY path, run ORDER BY ts, seq) AS k FROM g) SELECT path, seq, size, {ts('ts')} AS at FROM n WHERE size IS NOT NULL AND k % 3 = 0""",
)
def l2(spark, sf):
    return W.stable_batch(_observations(spark, sf), 3)


def _progress_events(spark, sf):
    return V.load(spark, sf, "events").selectExpr(
        "user_id AS file_id",
        "event_id AS seq",
        "CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'purchase' THEN 'done' ELSE 'progress' END AS kind",
        "cast(get_json_object(props, '$.k') AS int) AS percent",
        "value AS eta_s",
        "event_id % 3 > 0 AS success",
        "cast(1000 AS bigint) AS total_files",
    )


_PROG = """e AS (SELECT user_id AS file_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'done' ELSE 'progress' END AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS percent, value, event_id % 3 > 0 AS success FROM events)"""


@query(
    "L3_file_progress",
    f"""WITH {_PROG}, a AS (SELECT file_id, max_by(kind, seq) AS lk, max_by(percent, seq) FILTER (kind = 'progress') AS p, max_by(value, seq) FILTER (kind = 'progress') AS eta, max_by(success, seq) FILTER (kind = 'done') AS ok FROM e GROUP BY 1)
    SELECT file_id, CASE WHEN lk = 'done' THEN 100 ELSE coalesce(p, 0) END AS percent, round(CASE WHEN lk <> 'done' THEN eta END, 6) AS eta_s, CASE WHEN lk <> 'done' THEN 'processing' WHEN ok THEN 'done' ELSE 'failed' END AS state FROM a""",
)
def l3(spark, sf):
    return P.file_progress(_progress_events(spark, sf))


@query(
    "L3_overall_progress",
    f"WITH {_PROG} SELECT count(*) FILTER (kind = 'done') AS done, count(*) FILTER (kind = 'done' AND success) AS succeeded, 1000 AS total FROM e",
)
def l3o(spark, sf):
    return P.overall_progress(_progress_events(spark, sf))


_TYPES_SQL = "CASE event_type WHEN 'click' THEN 'on_transcode_complete' WHEN 'view' THEN 'on_merge_complete' WHEN 'purchase' THEN 'on_upload_complete' WHEN 'error' THEN 'on_error' ELSE 'on_other' END"


def _notices(spark, sf):
    return V.load(spark, sf, "events").selectExpr("event_id", f"{_TYPES_SQL} AS event_type")


def _channels(spark):
    """Channel configuration: one is on by default, one lacks its setting."""
    rows = [
        ("macos", None, None),
        ("telegram", True, {"bot_token": "t", "chat_id": "c"}),
        ("discord", True, {"webhook_url": "w"}),
        ("slack", True, {"webhook_url": ""}),
    ]
    return spark.createDataFrame(rows, "channel string, enabled boolean, settings map<string,string>")


def _rules(spark, **enabled):
    return spark.createDataFrame(list(enabled.items()) or [], "event_type string, enabled boolean")


@query(
    "L4_event_routing",
    f"SELECT event_id, event_type, channel FROM (SELECT event_id, {_TYPES_SQL} AS event_type FROM events), (SELECT unnest(['macos', 'telegram', 'discord']) AS channel) WHERE event_type IN ('on_transcode_complete', 'on_merge_complete', 'on_error')",
)
def l4(spark, sf):
    rules = _rules(spark, on_transcode_complete=True, on_upload_complete=False, on_error=None)
    return R.route(_notices(spark, sf), R.subscriptions(rules, _channels(spark)))


@query(
    "L5_upkeep_fold",
    f"""WITH {_EVENTS_SQL}, f AS (SELECT job_id, {_last('st', "CASE action WHEN 'finish' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'reset' THEN 'pending' ELSE action END", "'processing','finish','fail','reset','merged'")} FROM ev GROUP BY 1)
    SELECT CASE WHEN st IS NULL THEN j.status ELSE st[1] END AS status, count(*) AS cnt FROM jobs j LEFT JOIN f ON f.job_id = j.id GROUP BY 1""",
)
def l5(spark, sf):
    """Events applied in three consecutive batches give what one batch gives."""
    jobs, events = V.jobs(spark, sf), _job_events(spark, sf)
    for low, high in (("-1", "300000000"), ("300000000", "600000000"), ("600000000", "9223372036854775807")):
        jobs = K.apply_job_events(jobs, events.filter(f"seq > {low} AND seq <= {high}"))
    return D.status_counts(jobs)


_RULE_TYPE = "CASE (event_id {0} 40) % 4 WHEN 0 THEN 'on_transcode_complete' WHEN 1 THEN 'on_merge_complete' WHEN 2 THEN 'on_upload_complete' ELSE 'on_error' END"


@query(
    "L6_rule_reload",
    f"""WITH n AS (SELECT event_id, {_TYPES_SQL} AS event_type, ts FROM events),
    r AS (SELECT {_RULE_TYPE.format('//')} AS event_type, ts AS valid_from, max_by(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 > 0 END, event_id) AS enabled, max(event_id) FROM events WHERE event_id % 40 = 7 GROUP BY 1, 2),
    s AS (SELECT n.event_id, n.event_type, coalesce(r.enabled, true) AS sent FROM n ASOF LEFT JOIN r ON n.event_type = r.event_type AND n.ts >= r.valid_from)
    SELECT event_id, event_type, channel FROM s, (SELECT unnest(['macos', 'telegram', 'discord']) AS channel) WHERE sent AND event_type <> 'on_other'""",
)
def l6(spark, sf):
    """Every fortieth event changes a rule; each event goes by the rules of its moment."""
    events = V.load(spark, sf, "events")
    changes = events.where("event_id % 40 = 7").selectExpr(
        "event_id AS rule_id",
        f"{_RULE_TYPE.format('div')} AS event_type",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 > 0 END AS enabled",
        "ts AS valid_from",
    )
    notices = events.selectExpr("event_id", f"{_TYPES_SQL} AS event_type", "ts AS at")
    return R.route_as_of(notices, changes, _channels(spark)).drop("at")
