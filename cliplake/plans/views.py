"""Catalogue views derived from the driver's tables, for Spark and as DuckDB text.

Every view keeps all rows of the table it comes from.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliplake.operators.ordered import hour_of, number_rows, scan

def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# --------------------------------------------------------------------------- videos
def videos(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").selectExpr(
        "p_partkey AS id",
        "concat('/media/', p_type, '/', replace(p_name, ' ', '_'), '_', p_partkey, '.mp4') AS original_path",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(p_partkey AS int)) AS creation_time",
        "CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_retailprice END AS duration_seconds",
        "CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN '' ELSE p_brand END AS device_model",
        "p_size > 25 AS is_portrait",
        "pmod(p_partkey * 1000003, 5000000000) AS size_bytes",
        "p_type AS folder",
    ).withColumn("creation_text", F.date_format("creation_time", "yyyy-MM-dd'T'HH:mm:ss"))


SQL = {
    "videos": """SELECT p_partkey AS id,
        '/media/' || p_type || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.mp4' AS original_path,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey) AS creation_time,
        CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_retailprice END AS duration_seconds,
        CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN '' ELSE p_brand END AS device_model,
        p_size > 25 AS is_portrait, (p_partkey * 1000003) % 5000000000 AS size_bytes, p_type AS folder,
        strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey), '%Y-%m-%dT%H:%M:%S') AS creation_text
        FROM part""",
    "jobs": """SELECT event_id AS id, user_id AS video_id,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE '/work/' || event_id || '.mp4' END AS temp_file_path,
        CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
            WHEN 'error' THEN 'failed' ELSE 'merged' END AS status,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS progress_percent, ts AS started_at,
        CASE WHEN event_type IN ('purchase', 'error', 'signup')
            THEN ts + to_milliseconds(CAST(trunc(value * 1000) AS BIGINT)) END AS completed_at,
        CASE WHEN event_type = 'error' THEN 'exit code ' || (event_id % 7) END AS error_message,
        ts AS created_at FROM events""",
    "merges": """SELECT o_orderkey AS id,
        '/out/' || o_custkey || '/' || strftime(o_orderdate, '%Y-%m') || '.mp4' AS output_path,
        CASE WHEN o_orderkey % 17 = 0 THEN 'not json'
            ELSE '[' || o_custkey || ',' || (o_orderkey % 2000) || ']' END AS video_ids,
        CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN o_orderpriority LIKE '1-%' THEN 'yt' || o_orderkey END AS youtube_id,
        'Trip ' || o_custkey AS title,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
        o_totalprice / 10 AS total_duration_seconds, CAST(floor(o_totalprice * 1024) AS BIGINT) AS total_size_bytes,
        o_orderdate AS created_at FROM orders""",
    "splits": """SELECT o_orderkey AS id, o_orderkey AS merge_job_id,
        CASE WHEN o_orderpriority LIKE '1-%' THEN 'size' ELSE 'duration' END AS split_criterion,
        CASE WHEN o_orderkey % 11 = 0 THEN 'oops'
            ELSE '["/out/' || o_custkey || '/a_000.mp4","/out/' || o_custkey || '/a_001.mp4"]' END AS output_files,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '{bad' ELSE '["y' || o_orderkey || '"]' END AS youtube_ids,
        CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'failed' ELSE 'completed' END AS status,
        o_orderdate AS created_at FROM orders""",
    "archive_history": """SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS video_id,
        CASE WHEN l_returnflag = 'A' THEN 'delete' ELSE 'move' END AS operation,
        '/media/' || l_partkey || '.mp4' AS original_path,
        CASE WHEN l_returnflag = 'A' THEN NULL ELSE '/vault/' || l_suppkey || '/' || l_partkey || '.mp4' END AS destination_path,
        l_shipdate AS archived_at FROM lineitem""",
    "backup_history": """SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS merge_job_id,
        '/out/' || l_orderkey || '_' || l_partkey || '.mp4' AS source_path, 'remote' || (l_suppkey % 5) AS remote,
        CASE l_linenumber % 4 WHEN 0 THEN 'output' WHEN 1 THEN 'split' WHEN 2 THEN 'timelapse' ELSE 'original' END AS source_type,
        l_linestatus = 'F' AS success, CASE WHEN l_linestatus <> 'F' THEN 'quota' END AS error_message,
        l_shipdate AS backed_up_at FROM lineitem""",
    "projects": """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS description,
        TIMESTAMP '2024-01-01 00:00:00' AS created_at,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS updated_at FROM customer""",
    "links": "SELECT o_custkey AS project_id, o_orderkey AS merge_job_id, o_orderdate AS added_at FROM orders",
    "clips": """SELECT l_orderkey AS merge_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
            l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS position,
        l_partkey AS video_id, 'clip_' || l_partkey || '.mp4' AS name, l_quantity AS duration,
        CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'g' || (l_suppkey % 3) END AS grp,
        CASE l_returnflag WHEN 'A' THEN NULL WHEN 'R' THEN 'GoPro' ELSE 'Cam ' || (l_suppkey % 5) END AS device,
        strftime(l_shipdate, '%H:%M:%S') AS shot_time FROM lineitem""",
    "ranked_events": """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events""",
    "seqfiles": """SELECT event_id AS id, user_id AS batch, rn - 1 AS idx, ts AS creation_time,
        'DJI_' || strftime(ts, '%Y%m%d%H%M%S') || '_' || lpad(CAST(rn % 20 AS VARCHAR), 4, '0') || '_D.MP4' AS name,
        CASE WHEN value > 30 THEN 4294967296 - (event_id % 1000) * 1000 ELSE 2147483648 END AS size_bytes
        FROM ranked_events""",
    "camfiles": """SELECT event_id AS id, user_id AS batch, rn - 1 AS idx, ts AS creation_time,
        CASE event_type
            WHEN 'click' THEN 'GH' || lpad(CAST(rn % 5 AS VARCHAR), 2, '0') || lpad(CAST(rn // 10 % 10000 AS VARCHAR), 4, '0') || '.MP4'
            WHEN 'view' THEN 'GOPR' || lpad(CAST(rn // 10 % 10000 AS VARCHAR), 4, '0') || '.MP4'
            WHEN 'purchase' THEN 'gp' || lpad(CAST(rn % 5 AS VARCHAR), 2, '0') || lpad(CAST(rn // 10 % 10000 AS VARCHAR), 4, '0') || '.mp4'
            WHEN 'error' THEN 'DJI_' || strftime(ts, '%Y%m%d%H%M%S') || '_' || lpad(CAST(rn % 20 AS VARCHAR), 4, '0') || '_D.MP4'
            ELSE 'IMG_' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.MOV' END AS name,
        CASE WHEN value > 30 THEN 4294967296 - (event_id % 1000) * 1000 ELSE 2147483648 END AS size_bytes,
        CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' ELSE 'Cam ' || (event_id % 4) END AS device
        FROM ranked_events""",
    "progress_log": """SELECT user_id AS media_id, rn AS line_no,
        CASE WHEN event_type = 'error' THEN 'Error while decoding' ELSE
            printf('frame=%5d fps=%d.5 time=%02d:%02d:%02d.%02d bitrate=%d.0kbits/s', event_id, event_id % 60,
                event_id % 3, event_id % 60, event_id % 59, event_id % 100, event_id % 5000) END AS line
        FROM ranked_events""",
    "silence_log": """SELECT user_id AS media_id, rn AS line_no,
        CASE event_type WHEN 'click' THEN '[silencedetect @ 0x1] silence_start: ' || (rn * 2) || '.5'
            WHEN 'view' THEN '[silencedetect @ 0x1] silence_end: ' || (rn * 2 + 1) || '.25 | silence_duration: 1'
            ELSE 'frame=' || event_id END AS line FROM ranked_events""",
    "samples": """SELECT vec_id // 4 AS session, CASE WHEN vec_id % 4 = 0 THEN 'reference' ELSE 'external' END AS role,
        CASE WHEN vec_id % 4 = 0 THEN 0 ELSE (vec_id % 4 - 1) * 64 END + pos - 1 AS idx,
        CAST(embedding[pos] AS DOUBLE) AS sample
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)""",
    "segments": """SELECT conv_id AS media_id, turn AS seq, text,
        coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 10.0 AS start_s,
        sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 10.0 AS end_s
        FROM conversations""",
}
_NEEDS = {name: [] for name in SQL} | {
    v: ["ranked_events"] for v in ("seqfiles", "camfiles", "progress_log", "silence_log")
}


def sql(body: str) -> str:
    """Put the views a query names in front of it."""
    wanted: list[str] = []
    for name in SQL:
        if re.search(rf"\b{name}\b", body):
            for need in [*_NEEDS[name], name]:
                if need not in wanted:
                    wanted.append(need)
    if not wanted:
        return body.strip()
    body = body.strip()
    head = ",\n".join(f"{v} AS (\n{SQL[v]})" for v in wanted)
    own = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if own:
        return f"WITH {own.group(1) or ''}{head},\n" + body[own.end() :]
    return f"WITH {head}\n{body}"


# --------------------------------------------------------------------------- other tables
def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").selectExpr(
        "event_id AS id",
        "user_id AS video_id",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('/work/', event_id, '.mp4') END AS temp_file_path",
        "CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'"
        " WHEN 'error' THEN 'failed' ELSE 'merged' END AS status",
        "cast(get_json_object(props, '$.k') AS int) AS progress_percent",
        "ts AS started_at",
        "CASE WHEN event_type IN ('purchase', 'error', 'signup')"
        " THEN timestampadd(MILLISECOND, cast(value * 1000 AS bigint), ts) END AS completed_at",
        "CASE WHEN event_type = 'error' THEN concat('exit code ', event_id % 7) END AS error_message",
        "ts AS created_at",
    )


_ORDER_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'failed' ELSE 'completed' END AS status"


def merges(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(
        "o_orderkey AS id",
        "concat('/out/', o_custkey, '/', date_format(o_orderdate, 'yyyy-MM'), '.mp4') AS output_path",
        "CASE WHEN o_orderkey % 17 = 0 THEN 'not json'"
        " ELSE concat('[', o_custkey, ',', o_orderkey % 2000, ']') END AS video_ids",
        _ORDER_STATUS,
        "CASE WHEN o_orderpriority LIKE '1-%' THEN concat('yt', o_orderkey) END AS youtube_id",
        "concat('Trip ', o_custkey) AS title",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS date",
        "o_totalprice / 10 AS total_duration_seconds",
        "cast(floor(o_totalprice * 1024) AS bigint) AS total_size_bytes",
        "o_orderdate AS created_at",
    )


def splits(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(
        "o_orderkey AS id",
        "o_orderkey AS merge_job_id",
        "CASE WHEN o_orderpriority LIKE '1-%' THEN 'size' ELSE 'duration' END AS split_criterion",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'oops' ELSE"
        " concat('[\"/out/', o_custkey, '/a_000.mp4\",\"/out/', o_custkey, '/a_001.mp4\"]') END AS output_files",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '{bad'"
        " ELSE concat('[\"y', o_orderkey, '\"]') END AS youtube_ids",
        _ORDER_STATUS,
        "o_orderdate AS created_at",
    )


def archive_history(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS id",
        "l_partkey AS video_id",
        "CASE WHEN l_returnflag = 'A' THEN 'delete' ELSE 'move' END AS operation",
        "concat('/media/', l_partkey, '.mp4') AS original_path",
        "CASE WHEN l_returnflag = 'A' THEN NULL"
        " ELSE concat('/vault/', l_suppkey, '/', l_partkey, '.mp4') END AS destination_path",
        "l_shipdate AS archived_at",
    )


def backup_history(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS id",
        "l_orderkey AS merge_job_id",
        "concat('/out/', l_orderkey, '_', l_partkey, '.mp4') AS source_path",
        "concat('remote', l_suppkey % 5) AS remote",
        "CASE l_linenumber % 4 WHEN 0 THEN 'output' WHEN 1 THEN 'split' WHEN 2 THEN 'timelapse'"
        " ELSE 'original' END AS source_type",
        "l_linestatus = 'F' AS success",
        "CASE WHEN l_linestatus <> 'F' THEN 'quota' END AS error_message",
        "l_shipdate AS backed_up_at",
    )


def projects(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").selectExpr(
        "c_custkey AS id",
        "c_name AS name",
        "c_mktsegment AS description",
        "timestamp_ntz'2024-01-01 00:00:00' AS created_at",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(c_custkey AS int)) AS updated_at",
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(
        "o_custkey AS project_id", "o_orderkey AS merge_job_id", "o_orderdate AS added_at"
    )


def clips(spark: SparkSession, sf: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", *order)
    # an order has a handful of lines, so a plain window serves, and the lists are short for
    # the operators behind it (``short``), which then need no further exchange
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("bigint")
    return rows.withColumn("position", place).selectExpr(
        "l_orderkey AS merge_id",
        "position",
        "l_partkey AS video_id",
        "concat('clip_', l_partkey, '.mp4') AS name",
        "l_quantity AS duration",
        "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('g', l_suppkey % 3) END AS grp",
        "CASE l_returnflag WHEN 'A' THEN NULL WHEN 'R' THEN 'GoPro' ELSE concat('Cam ', l_suppkey % 5) END AS device",
        "date_format(l_shipdate, 'HH:mm:ss') AS shot_time",
    )


def ranked_events(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    rows = load(spark, sf, "events").select("event_id", "ts", "user_id", *columns)
    return number_rows(rows, ["user_id"], ["ts", "event_id"], hour_of(F.col("ts")), "rn")


_SIZE = "CASE WHEN value > 30 THEN 4294967296 - (event_id % 1000) * 1000 ELSE 2147483648 END AS size_bytes"
_DJI = "concat('DJI_', date_format(ts, 'yyyyMMddHHmmss'), '_', lpad(rn % 20, 4, '0'), '_D.MP4')"


def seqfiles(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_events(spark, sf, "value").selectExpr(
        "event_id AS id", "user_id AS batch", "rn - 1 AS idx", "ts AS creation_time", f"{_DJI} AS name", _SIZE
    )


def camfiles(spark: SparkSession, sf: str) -> DataFrame:
    session = "lpad((rn div 10) % 10000, 4, '0')"
    chapter = "lpad(rn % 5, 2, '0')"
    return ranked_events(spark, sf, "value", "event_type").selectExpr(
        "event_id AS id",
        "user_id AS batch",
        "rn - 1 AS idx",
        "ts AS creation_time",
        f"CASE event_type WHEN 'click' THEN concat('GH', {chapter}, {session}, '.MP4')"
        f" WHEN 'view' THEN concat('GOPR', {session}, '.MP4')"
        f" WHEN 'purchase' THEN concat('gp', {chapter}, {session}, '.mp4')"
        f" WHEN 'error' THEN {_DJI} ELSE concat('IMG_', lpad(event_id, 9, '0'), '.MOV') END AS name",
        _SIZE,
        "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN ''"
        " ELSE concat('Cam ', event_id % 4) END AS device",
    )


def progress_log(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_events(spark, sf, "event_type").selectExpr(
        "user_id AS media_id",
        "rn AS line_no",
        "CASE WHEN event_type = 'error' THEN 'Error while decoding' ELSE"
        " format_string('frame=%5d fps=%d.5 time=%02d:%02d:%02d.%02d bitrate=%d.0kbits/s', event_id, event_id % 60,"
        " event_id % 3, event_id % 60, event_id % 59, event_id % 100, event_id % 5000) END AS line",
    )


def silence_log(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_events(spark, sf, "event_type").selectExpr(
        "user_id AS media_id",
        "rn AS line_no",
        "CASE event_type WHEN 'click' THEN concat('[silencedetect @ 0x1] silence_start: ', rn * 2, '.5')"
        " WHEN 'view' THEN concat('[silencedetect @ 0x1] silence_end: ', rn * 2 + 1, '.25 | silence_duration: 1')"
        " ELSE concat('frame=', event_id) END AS line",
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").selectExpr(
        "vec_id div 4 AS session",
        "CASE WHEN vec_id % 4 = 0 THEN 'reference' ELSE 'external' END AS role",
        "CASE WHEN vec_id % 4 = 0 THEN 0 ELSE (vec_id % 4 - 1) * 64 END AS base",
        "posexplode(embedding) AS (pos, value)",
    ).selectExpr("session", "role", "base + pos AS idx", "cast(value AS double) AS sample")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "conversations").selectExpr("conv_id AS media_id", "turn AS seq", "text")
    return scan(
        rows,
        ["media_id"],
        ["seq"],
        F.expr("seq div 1024"),
        __chars=("sum", F.length("text").cast("bigint")),
    ).selectExpr(
        "media_id",
        "seq",
        "text",
        "coalesce(__chars, 0) / 10.0D AS start_s",
        "(coalesce(__chars, 0) + length(text)) / 10.0D AS end_s",
    )


View = Callable[[SparkSession, str], DataFrame]
